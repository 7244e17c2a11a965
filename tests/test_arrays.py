"""Arrays read in parallel pieces, against Python's JSON reader."""

import gzip
import json
import random

import pytest
from conftest import small_log

from eventlens.plans.stash import setting
from eventlens.sources import arrays, readers
from eventlens.sources.arrays import array_elements, pieces, several_splits, split_states


@pytest.fixture()
def small_splits(spark):
    """Splits of 2000 bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def values(spark, path):
    return [r.value for r in array_elements(spark, str(path)).collect()]


def same(got, want):
    def normal(x):
        return json.dumps(x, sort_keys=True)

    def load(v):
        try:
            return json.loads(v)
        except ValueError:
            return v
    assert sorted(normal(load(v)) for v in got) == sorted(normal(w) for w in want)


def random_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind == 0:
        return rng.randrange(10**6)
    if kind == 1:
        return "".join(rng.choice('ab}{][",\\ \n é漢') for _ in range(rng.randrange(30)))
    if kind in (2, 3):
        return rng.choice([True, None, 1.5, "x" * rng.randrange(40)])
    if kind == 4:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{j}}}": random_value(rng, depth + 1) for j in range(rng.randrange(5))}


@pytest.mark.parametrize("indent", [None, 1])
def test_objects_in_many_splits(small_splits, tmp_path, indent):
    rng = random.Random(7)
    want = [{"n": k, "v": [random_value(rng) for _ in range(3)]} for k in range(300)]
    (tmp_path / "a.json").write_text(json.dumps(want, indent=indent, ensure_ascii=bool(indent)))
    found = pieces(small_splits, str(tmp_path))
    assert found.rdd.getNumPartitions() > 8 and split_states(found).count() > 8
    same(values(small_splits, tmp_path), want)


def test_other_elements_and_several_files(small_splits, tmp_path):
    rng = random.Random(8)
    every = []
    for k in range(8):
        want = [random_value(rng) if rng.random() < 0.5 else {"f": k, "x": random_value(rng)} for _ in range(rng.randrange(120))]
        want = [w for w in want if not isinstance(w, str) and w is not None]  # a text or null element has no JSON text of its own
        (tmp_path / f"{k}.json").write_text(rng.choice(["", "﻿", " \n"]) + json.dumps(want) + rng.choice(["", "\n"]))
        every += want
    same(values(small_splits, tmp_path), every)


@pytest.mark.parametrize("text", ["[]", " [ ] \n", "", "  \n"])
def test_nothing_in_it(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert [v for v in values(spark, tmp_path) if text.strip()] == []


def test_cut_anywhere_leaves_whole_elements_and_one_reject(small_splits, tmp_path):
    log = [{"k": k, "in": {"x": [k, {"y": "}"}]}} for k in range(120)]
    text = json.dumps(log, indent=1)
    rng = random.Random(3)
    spots = [text.index("},\n {", 6000) + d for d in (1, 2, 3, 5)] + [rng.randrange(5000, len(text) - 2) for _ in range(3)]
    for number, spot in enumerate(spots):
        folder = tmp_path / str(number)
        folder.mkdir()
        (folder / "a.json").write_text(text[:spot])
        whole = 0
        decoder, at = json.JSONDecoder(), 1
        while True:
            try:
                _, at = decoder.raw_decode(text[:spot], at + len(text[at:spot]) - len(text[at:spot].lstrip(", \n")))
                whole += 1
            except ValueError:
                break
        got = values(small_splits, folder)
        good = [v for v in got if v.startswith("{") and v.endswith("}") and v.count("}") >= 4 and json.loads(v) in log]
        assert (len(good), len(got)) == (whole, whole + 1), spot


def test_text_behind_the_array_and_broken_nesting_are_kept(small_splits, tmp_path):
    log = [{"k": k} for k in range(300)]
    (tmp_path / "a.json").write_text(json.dumps(log[:250]) + ' {"more": 1} tail')
    got = values(small_splits, tmp_path)
    assert [json.loads(v) for v in got if v.startswith('{"k')] == log[:249] or len([v for v in got if '"k"' in v]) >= 249
    assert any("tail" in v for v in got)


def test_gzip_and_the_line_form(small_splits, tmp_path):
    log = small_log()
    for name, opener in (("a.json", open), ("b.json.gz", gzip.open)):
        folder = tmp_path / name
        folder.mkdir()
        with opener(folder / name, "wt") as f:
            json.dump(log, f, indent=1)
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "l").write_text("\n".join(json.dumps(e) for e in log))
    want = readers.scan_ndjson(small_splits, str(lines)).drop("file")
    for name in ("a.json", "b.json.gz"):
        got = readers.scan_json_array(small_splits, str(tmp_path / name)).drop("file")
        assert got.schema == want.schema
        assert [sorted(str(r).replace(" ", "") for r in x.collect()) for x in (got,)] == [sorted(str(r).replace(" ", "") for r in want.collect())]


def test_files_of_one_split_are_read_once_and_nothing_is_stored(spark, tmp_path, monkeypatch):
    def refuse(*args):
        raise AssertionError("more than one reading")

    rng = random.Random(11)
    every = []
    for k in range(6):
        want = [{"f": k, "v": [random_value(rng) for _ in range(3)]} for _ in range(rng.randrange(90))] + [k, [k]]
        with (gzip.open if k % 2 else open)(tmp_path / f"a [{k}] é%20.json{'.gz' * (k % 2)}", "wt", encoding="utf-8") as f:
            json.dump(want, f, indent=rng.choice([None, 1]))
        every += want
    assert not several_splits(pieces(spark, str(tmp_path)))
    monkeypatch.setattr(arrays, "stash", refuse)
    monkeypatch.setattr(arrays, "split_states", refuse)
    found = array_elements(spark, str(tmp_path))
    same([r.value for r in found.collect()], every)
    assert found.select("file").distinct().count() == 6


def test_one_split_or_several_give_the_same_elements(spark, tmp_path):
    rng = random.Random(12)
    odd = ["", "[]", "[", "[1, 2]", "[{}", "[{},", '[{"a":"}"}\n,{"b":1}\n]', '[{"a":\n1}, 5,\r\n{"b":2}, [3]\n]', '["}", {"a":2}, "{"]', '[{"a":1},,{"b":1}]', '{"a":1}\n{"b":2}\n', "no JSON"]
    for k in range(40):
        text = json.dumps([{"f": k, "x": random_value(rng)} if rng.random() < 0.7 else random_value(rng) for _ in range(50)], indent=rng.choice([None, 1]))
        odd.append(text[:rng.randrange(len(text))] if k % 2 else text + rng.choice(["", "\n", " tail", ' {"more": 1}']))
    for k, text in enumerate(odd):
        (tmp_path / f"{k}.json").write_text(text)
    whole = sorted((r.file, r.value or "") for r in array_elements(spark, str(tmp_path)).collect())
    with setting(spark, "spark.sql.files.maxPartitionBytes", "500"), setting(spark, "spark.sql.files.openCostInBytes", "1"):
        assert several_splits(pieces(spark, str(tmp_path)))
        assert sorted((r.file, r.value or "") for r in array_elements(spark, str(tmp_path)).collect()) == whole


def test_arrays_are_cut_and_parsed_once(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump(small_log(), f)
    events = readers.scan_json_array(spark, str(tmp_path))
    plan = events.groupBy("Event").count()._jdf.queryExecution().toString()
    assert "from_json" not in plan and "MapInArrow" not in plan and "ReadSchema: struct<Event:string>" in plan
    assert events.where("Event IS NOT NULL").count() == len(small_log())


def test_blank_lines_are_not_measured(spark, tmp_path):
    (tmp_path / "a").write_text('{"Event": "x"}\n\n   \n{"Event": "y"}\n')
    lines = readers.scan_lines(spark, str(tmp_path))
    parsed = readers.parse_lines(lines)
    assert "length" not in parsed._jdf.queryExecution().optimizedPlan().toString() and "length" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.Event for r in parsed.collect()) == ["x", "y"]
