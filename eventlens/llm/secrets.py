"""Secret scan: fixed patterns and a battery of randomness tests, in DataFrame functions only.

Patterns give the base spans. Other long runs of encoding letters are candidates: for the encoding each is inferred to
be in, chi-squared against equal shares of the alphabet, the runs of letter classes and the serial correlation of letter
values say how far it is from ordinary text. The three are combined into one probability (1 if uniformity is refused),
and a text's candidates are accepted together by a false-discovery procedure (Benjamini-Hochberg) with weights by length,
since short runs prove little.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import whole_rows

#: kind -> (pattern, part whose length counts, least length); fixed values of the scan.
BASE = {
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
KINDS = [*BASE, "random"]
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: encoding -> (pattern, letters in its alphabet, chance that two letters of an ordinary name in it are equal). The first that fits is inferred.
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", 16, 0.12),
    "alpha26": (r"^([a-z]+|[A-Z]+)$", 26, 0.065),
    "base32": (r"^[A-Z2-7]+$", 32, 0.07),
    "base36": (r"^([a-z0-9]+|[A-Z0-9]+)$", 36, 0.065),
    "alpha52": (r"^[A-Za-z]+$", 52, 0.06),
    "base62": (r"^[A-Za-z0-9]+$", 62, 0.06),
    "base64": (r"^[A-Za-z0-9+/_-]+$", 64, 0.055),
}
#: A run is no secret where uniformity over its alphabet is refused at one in a thousand (normal quantile).
UNIFORM = 3.09
#: Ordinary names change the class of letter at this share of their places, and have at least this serial correlation. In one
#: alphabet of 26 the classes are vowels and consonants, between which words change more often than chance does.
SWITCH, SERIAL, SPREAD = 0.2, 0.3, 0.002
VOWEL_SWITCH = 0.6
LEVEL = 0.01
#: Code points in a block when a text is put together anew.
BLOCK = 4096
_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(values: list[tuple[str, str]], body: str) -> str:
    """SQL for ``body`` with each value named for those that follow, so that nothing is computed twice."""
    for name, value in reversed(values):
        body = f"transform(array({value}), {name} -> {body})[0]"
    return body


def _blocks(values: str, n: str) -> list[tuple[str, str]]:
    """Names ``width`` and ``blocks``: an array of ``n`` values in blocks of about its root, so that what runs along it is never
    copied whole for each of its places."""
    return [("width", f"greatest(1, int(ceil(sqrt({n}))))"), ("blocks", f"transform(sequence(0, ({n} - 1) div width), b -> slice({values}, b * width + 1, width))")]


def _places(text: str, pattern: str, kind: str, part: int, least: int) -> str:
    """Array of (start, rank, kind, end, token): code points, end exclusive.

    Pieces between the matches and the matches themselves alternate, so their lengths add up to the places.
    """
    p = _quoted(pattern)
    steps = "zip_with(slice(pieces, 1, size(hits)), hits, (x, y) -> struct(char_length(x) AS gap, char_length(y) AS len))"
    none = "cast(array() AS array<struct<s:int,e:int>>)"
    within = (f"aggregate(x, struct(aggregate(slice(sums, 1, i), 0, (a, y) -> a + y) AS at, {none} AS out), "
              "(a, m) -> struct(a.at + m.gap + m.len AS at, concat(a.out, array(struct(a.at + m.gap AS s, a.at + m.gap + m.len AS e))) AS out), a -> a.out)")
    walk = _let([("steps", steps), *_blocks("steps", "size(steps)"), ("sums", "transform(blocks, x -> aggregate(x, 0, (a, y) -> a + y.gap + y.len))")],
                f"flatten(transform(blocks, (x, i) -> {within}))")
    rank = KINDS.index(kind)
    found = (f"zip_with(zip_with(if(size(hits) = 0, {none}, {walk}), hits, (w, x) -> struct(w.s AS s, w.e AS e, x AS t)), counted, "
             f"(w, y) -> struct(w.s AS start, {rank} AS rank, '{kind}' AS kind, w.e AS end, w.t AS token, char_length(y) AS n))")
    values = [("pieces", f"split({text}, {p}, -1)"), ("hits", f"regexp_extract_all({text}, {p}, 0)"), ("counted", f"regexp_extract_all({text}, {p}, {part})" if part else "hits")]
    return f"filter({_let(values, found)}, x -> x.n >= {least})"


def _statistics(c: str) -> str:
    """One candidate's (start, end, n, p): probability that an ordinary name looks as random; 1 where uniformity is refused.

    ``x`` is Pearson's chi-squared against equal shares of the inferred alphabet. It is read twice: against its own
    distribution if letters are uniform (Wilson and Hilferty's cube root), and against what ordinary names give, whose
    letters collide more often.
    """
    case = "CASE " + " ".join(f"WHEN b RLIKE {_quoted(p)} THEN struct('{e}' AS e, {size}D AS a, {k}D AS k)" for e, (p, size, k) in ENCODINGS.items())
    classes = " + ".join(f"size(regexp_extract_all(b, '{x}', 0))" for x in ("[a-z]+", "[A-Z]+", "[0-9]+", "[^a-zA-Z0-9]+"))
    vowels = " + ".join(f"size(regexp_extract_all(b, '(?i){x}', 0))" for x in ("[aeiouy]+", "[^aeiouy]+"))
    ordinary = "(c.a - 1 + (n - 1) * (c.a * c.k - 1))"
    chi = f"(x - {ordinary}) / (c.a * (n - 1) * sqrt(2 * c.k * (1 - c.k) / (n * (n - 1)) + {SPREAD}D * 4 * (n - 2) / (n * (n - 1))))"
    uniform = "power(x / (c.a - 1), 1D / 3) - (1 - 2 / (9 * (c.a - 1)))"
    share = "(r - 1) / (n - 1)"
    runs = (f"if(one, {share} - {VOWEL_SWITCH}D, {SWITCH}D - {share}) / sqrt(if(one, {VOWEL_SWITCH * (1 - VOWEL_SWITCH)}D, {SWITCH * (1 - SWITCH)}D) / (n - 1))")
    serial = f"(if(s > 0, abs(q) / s, 1D) - if(one, 0D, {SERIAL}D)) * sqrt(n - 3)"
    values = [
        ("b", f"rtrim('=', {c}.token)"),
        ("n", "cast(char_length(b) AS double)"),
        ("c", f"{case} END"),
        ("one", "c.e = 'alpha26'"),
        ("l", "split(b, '')"),
        ("x", "c.a / n * aggregate(array_distinct(l), 0D, (a, y) -> a + power(n - char_length(replace(b, y, '')), 2)) - n"),
        ("r", f"cast(if(one, {vowels}, {classes}) AS double)"),
        ("v", f"transform(l, y -> cast(instr('{_LETTERS}', y) AS double))"),
        ("m", "aggregate(v, 0D, (a, y) -> a + y) / n"),
        ("s", "aggregate(v, 0D, (a, y) -> a + (y - m) * (y - m))"),
        ("q", "aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (y, w) -> (y - m) * (w - m)), 0D, (a, y) -> a + y)"),
        ("z", f"({chi} + {runs} + {serial}) / sqrt(3D)"),
    ]
    p = f"if(({uniform}) / sqrt(2 / (9 * (c.a - 1))) > {UNIFORM}D, 1D, 1 / (1 + exp(-(1.5976D * z + 0.070565D * z * z * z))))"
    return _let(values, f"struct({c}.start AS start, {c}.end AS end, n AS n, {p} AS p)")


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _base and _spans: arrays of (start, rank, kind, end), ordered by start, then kind.

    Null text counts as empty. A candidate that overlaps a base span adds nothing. Decisions depend on the text alone.
    """
    text = f"coalesce({text_col}, '')"
    bare = "transform({}, x -> struct(x.start AS start, x.rank AS rank, x.kind AS kind, x.end AS end))"
    base = ", ".join(bare.format(_places(text, p, k, part, least)) for k, (p, part, least) in BASE.items())
    found = docs.withColumn("_base", F.expr(f"array_sort(concat({base}))"))
    found = found.withColumn("_tested", F.expr(f"transform({_places(text, CANDIDATE, 'random', 0, 20)}, t -> {_statistics('t')})"))
    weighed = "transform(_tested, c -> struct(c.start AS start, c.end AS end, c.p * mean_n / c.n AS p))"
    ranked = f"transform(array_sort(transform(weighed, c -> c.p)), (p, i) -> if(p <= {LEVEL}D * (i + 1) / size(weighed), p, -1D))"
    chosen = "filter(weighed, c -> c.p <= bar AND NOT exists(_base, b -> b.start < c.end AND c.start < b.end))"
    extra = _let([("mean_n", "aggregate(_tested, 0D, (a, x) -> a + x.n) / size(_tested)"), ("weighed", weighed), ("bar", f"array_max({ranked})")],
                 f"transform({chosen}, c -> struct(c.start AS start, {KINDS.index('random')} AS rank, 'random' AS kind, c.end AS end))")
    return found.withColumn("_spans", F.expr(f"if(size(_tested) > 0, array_sort(concat(_base, {extra})), _base)")).drop("_tested")


def _listed(name: str) -> str:
    return f"array_join(transform({name}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of every row; an empty table gives an empty one."""
    found = spans(docs.select("doc_id", "text"))
    count = {k: F.expr(f"cast(size(filter(_spans, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS}
    return found.select("doc_id", *(count[k] for k in BASE), F.sha2(F.expr(_listed("_base")), 256).alias("base_sha256"), F.expr(_listed("_spans")).alias("spans"), count["random"])


def masked(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mask`` and n_chars counted anew; overlapping spans become one.

    Columns stay as they are, whatever their names. Time and memory grow with the text,
    not with the number of spans squared. A null text stays null; an empty table gives an empty one."""
    found = spans(whole_rows(docs))
    gap = "array<struct<from:int,to:int>>"
    within = (f"aggregate(x, struct(greatest(0, array_max(slice(tops, 1, i))) AS at, cast(array() AS {gap}) AS out), "
              "(a, y) -> struct(greatest(a.at, y.end) AS at, concat(a.out, array(struct(a.at AS from, y.start AS to))) AS out), a -> a.out)")
    # The text in blocks, so that a piece of it is found without a walk from the beginning.
    piece = (f"if(from div {BLOCK} = to div {BLOCK}, coalesce(substring(get(cut, from div {BLOCK}), from % {BLOCK} + 1, to - from), ''), "
             f"concat(substring(cut[from div {BLOCK}], from % {BLOCK} + 1), array_join(slice(cut, from div {BLOCK} + 2, to div {BLOCK} - from div {BLOCK} - 1), ''), "
             f"coalesce(substring(get(cut, to div {BLOCK}), 1, to % {BLOCK}), '')))")
    for name in ("from", "to"):
        piece = re.sub(rf"\b{name}\b", f"g.{name}", piece)
    gaps = f"filter(flatten(transform(blocks, (x, i) -> {within})), g -> g.from <= g.to)"
    rest = "array(struct(array_max(tops) AS from, char_length(text) AS to))"
    text = _let([*_blocks("_spans", "size(_spans)"), ("tops", "transform(blocks, x -> array_max(transform(x, y -> y.end)))"), ("cut", f"regexp_extract_all(text, '(?s).{{1,{BLOCK}}}', 0)")],
                f"array_join(transform(concat({gaps}, {rest}), g -> {piece}), {_quoted(mask)})")
    hit = F.expr("size(_spans) > 0")
    found = found.withColumn("doc", F.col("doc").withField("text", F.when(hit, F.expr(text)).otherwise(F.col("text"))))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        found = found.withColumn("doc", F.col("doc").withField("n_chars", F.when(hit, F.char_length("doc.text").cast(kind)).otherwise(F.col("doc.n_chars"))))
    return found.select("doc.*")
