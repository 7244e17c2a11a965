"""Surrogates for personal data, in DataFrame functions only.

Detected entities are replaced by keyed ones of the same type: honorifics keep the gender, letters their script and
case, digits and punctuation their places. Every distinct entity gets one surrogate, wherever it occurs; the surrogates
of all entities are checked against each other and against the originals, and those that collide are made again with
the next attempt number, so that different entities stay different.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.secrets import _let, _quoted
from eventlens.plans.stash import stash

#: type -> pattern, in the order in which a match is named (fixed values of the detector). The look at the first character, and for
#: addresses at the one before (or the end of the last match), only spares the engine places where no match can begin.
TYPES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?=[+(\d])(?:(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\w(])\(\d{2,4}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?=\d)(?<![\d.-])(?:\d{4}[ -]?){3}\d{1,7}(?![\d-])",
    "person": r"(?=[MHFSГ])(?<!\p{L})(?:Mr|Mrs|Ms|Miss|Herr|Frau|Señora|Señor|Sra|Sr|Monsieur|Madame|Mme|Г-н|Г-жа)\.?[  ]\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?",
}
#: Given names by what the honorific says (fixed values); family names are made of syllables.
GIVEN = {"f": "Anna Clara Elena Emma Helen Irene Julia Laura Lucia Maria Nina Olivia Paula Sara Sofia Vera".split(),
         "m": "Adam Albert Daniel David Erik Felix Hugo Jonas Leo Lucas Martin Oscar Paul Simon Thomas Victor".split()}
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Г-жа)"
SYLLABLES = "ba de fi go ku la me ni po ra se ti vo wa xa zu bel dan fer gol".split()
#: A character that no text should hold (a Unicode noncharacter); where one does, its digest joins the mark.
MARK = "\ufdd0"
ANY = "|".join(f"(?:{p})" for p in TYPES.values())
#: (first, last code point) of ranges in which a letter is replaced by another of its own script and case.
SCRIPTS = [(0x41, 0x5A), (0x61, 0x7A), (0x30, 0x39), (0xC0, 0xD6), (0xE0, 0xF6), (0x391, 0x3A1), (0x3B1, 0x3C1), (0x410, 0x42F), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x3041, 0x3096), (0x30A1, 0x30FA),
           (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]


def _number(stream: str, i: str) -> str:
    """Number from two bytes of a hexadecimal stream at place i (from 0), the stream being read in a circle."""
    return f"cast(conv(substring({stream}, cast(pmod(({i}) * 4, 512) AS int) + 1, 4), 16, 10) AS int)"


def _stand_in(key: str) -> str:
    """SQL for the surrogate of ``norm``, an entity in its normal form, of type ``kind``, at ``attempt``."""
    secret = _quoted(key)
    seed = f"concat_ws('|', {secret}, kind, norm, cast(attempt AS string))"
    stream = "concat(" + ", ".join(f"sha2(concat('{k}', seed), 512)" for k in range(4)) + ")"
    ranges = " ".join(f"WHEN c RLIKE '[\\\\x{{{a:x}}}-\\\\x{{{b:x}}}]' THEN substring('{_range(a, b)}', {_number('stream', 'i')} % {min(b - a + 1, WIDTH)} + 1, 1)" for a, b in SCRIPTS)
    same_form = f"array_join(transform(split(body, ''), (c, i) -> CASE {ranges} ELSE c END), '')"
    ip = "array_join(transform(sequence(0, 3), i -> cast(" + _number("stream", "i") + " % 254 + 1 AS string)), '.')"
    given = {g: f"element_at(array({', '.join(repr(x) for x in names)}), {_number('stream', '0')} % {len(names)} + 1)" for g, names in GIVEN.items()}
    wide = "cast(attempt div 3 AS int)"
    syllable = [f"element_at(array({', '.join(repr(x) for x in SYLLABLES)}), {_number('stream', str(k))} % {len(SYLLABLES)} + 1)" for k in range(1, 5)]
    more = f"array_join(transform(if({wide} > 0, sequence(1, {wide}), array()), w -> element_at(array({', '.join(repr(x) for x in SYLLABLES)}), {_number('stream', '(w + 8)')} % {len(SYLLABLES)} + 1)), '')"
    family = f"initcap(concat({', '.join(syllable)}, {more}))"
    latin = (f"concat(regexp_extract(norm, '^([^ \\u00a0]+[ \\u00a0])', 1), if(size(split(norm, ' ')) > 2, concat(if(norm RLIKE {_quoted(FEMALE)}, {given['f']}, {given['m']}), ' '), ''), {family})")
    other = f"concat(regexp_extract(norm, '^([^ \\u00a0]+[ \\u00a0])', 1), made, {more})"
    made = f"CASE WHEN kind = 'ip' THEN {ip} WHEN kind = 'person' THEN if(norm RLIKE '[^\\\\x{{0}}-\\\\x{{24f}}]', {other}, {latin}) ELSE concat(made, tail) END"
    head = {"email": "regexp_extract(norm, '^(.*)\\\\.[^.]*$', 1)", "iban": "substring(norm, 3)", "person": "regexp_replace(norm, '^[^ \\u00a0]+[ \\u00a0]', '')", "phone": "regexp_replace(norm, '^[+][0-9]+', '')"}
    body = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in head.items()) + " ELSE norm END"
    tail = "CASE WHEN kind = 'email' THEN regexp_extract(norm, '(\\\\.[^.]*)$', 1) ELSE '' END"
    front = "CASE WHEN kind = 'iban' THEN left(norm, 2) WHEN kind = 'phone' THEN regexp_extract(norm, '^([+][0-9]+)', 1) ELSE '' END"
    # later attempts repeat the last letter or digit, which then gets a stand-in like the others
    room = f"if(kind = 'person', body, concat(body, repeat(regexp_extract(body, '([A-Za-z0-9])[^A-Za-z0-9]*$', 1), {wide})))"
    return _let([("seed", seed), ("stream", stream), ("body", body), ("body", room), ("tail", tail), ("front", front), ("made", same_form)], f"concat(front, {made})")


#: Letters used of a large script.
WIDTH = 256


def _range(a: int, b: int) -> str:
    return "".join(chr(x) for x in range(a, min(b + 1, a + WIDTH)))


def detected(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _parts: the text cut at its entities, which are the second, fourth, ... of the parts. A null text gives one empty part.

    The patterns run once over a text: they set marks that the text does not hold, and the text is cut there.
    """
    mark = f"if(contains(t, '{MARK}'), concat('{MARK}', md5(t), '{MARK}'), '{MARK}')"
    parts = _let([("t", f"coalesce({text_col}, '')"), ("mark", mark)], f"split(regexp_replace(t, {_quoted(ANY)}, concat(mark, '$0', mark)), mark, -1)")
    return docs.withColumn("_parts", F.expr(parts))


def _named(hit: str = "hit") -> tuple[str, str]:
    kind = "CASE " + " ".join(f"WHEN {hit} RLIKE {_quoted('^(?:' + p + ')$')} THEN '{k}'" for k, p in TYPES.items()) + " ELSE 'card' END"
    return kind, f"if({hit} LIKE '%@%', lower({hit}), {hit})"


def stand_ins(hits: DataFrame, key: str) -> DataFrame:
    """(norm, surrogate) for the distinct entities in ``hits`` (column hit).

    Attempts go on until no surrogate equals another one or an original: the smallest entity of a collision keeps its
    surrogate. Later attempts have more room (a further syllable, letter or digit group every third one), so a crowded form
    comes to an end whatever the number of entities. Everything is a join or an aggregate on values; the driver sees one
    count a round.
    """
    kind, norm = _named()
    todo = stash(hits.select(F.expr(norm).alias("norm"), F.expr(kind).alias("kind")).distinct())
    originals = todo.select(F.col("norm").alias("surrogate"))
    done = None
    attempt = 0
    while True:
        made = todo.select("norm", "kind", F.lit(attempt).alias("attempt")).select("norm", "kind", F.expr(_stand_in(key)).alias("surrogate"))
        first = made.groupBy("surrogate").agg(F.min("norm").alias("norm"))
        good = first.join(originals, "surrogate", "left_anti")
        if done is not None:
            good = good.join(done.select("surrogate"), "surrogate", "left_anti")
        good = stash(good.select("norm", "surrogate"))
        done = good if done is None else done.union(good)
        todo = stash(todo.join(good.select("norm"), "norm", "left_anti"))
        attempt += 1
        if todo.isEmpty():
            return done
        if attempt > 1000:  # only addresses of four numbers cannot grow
            raise ValueError("more than half of all IP addresses are taken; no distinct surrogates are left")


def replaced(docs: DataFrame, key: str = "corpus") -> DataFrame:
    """``docs`` with entities of ``text`` replaced and their number as n_entities (a column of that name is replaced).

    Every text is searched once; the cut texts are stored, and only those with an entity take part in the joins. Null texts
    stay null. Rows are numbered where they are stored, so repeated ids and rows do no harm; working columns are kept
    in a struct of their own, so no column of ``docs`` clashes with them. An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col("text"))
    cut = detected(own).select("doc", F.when(F.size("_parts") > 1, F.col("_parts")).alias("parts"), F.monotonically_increasing_id().alias("row"))
    cut = stash(cut)
    _, norm = _named()
    hits = stash(cut.where("parts IS NOT NULL").select("row", F.posexplode("parts").alias("at", "hit")).where("at % 2 = 1"))
    table = stash(stand_ins(hits, key))
    named = hits.withColumn("norm", F.expr(norm)).join(table, "norm").withColumn("by", F.expr("if(hit = upper(hit) AND hit LIKE '%@%', upper(surrogate), surrogate)"))
    lists = named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "by"))).alias("by"))  # one text's own entities
    filled = "array_join(transform(parts, (p, i) -> if(i % 2 = 1, by[cast((i - 1) / 2 AS int)].by, p)), '')"
    found = cut.where("parts IS NOT NULL").join(lists, "row")
    out = found.select(*(F.expr(filled).alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in names), F.size("by").cast("long").alias("n_entities"))
    clean = cut.where("parts IS NULL").select(*(F.col(f"doc.`{c}`").alias(c) for c in names), F.lit(0).cast("long").alias("n_entities"))
    return out.union(clean)
