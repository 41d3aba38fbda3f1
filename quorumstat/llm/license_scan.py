"""License scan by ordered signature rules.

A text is written as words, each between two blanks, so that every rule is a plain pattern
over whole words. A first gate looks for a few stems in the raw text; a rule's pattern then
runs only where its keyword occurs, a word that every match of the pattern has: alternatives
without a common word are rules of their own. Detections have a priority; one that lies inside
another of the same or a better priority is suppressed. Base phrases are reported at every
place and are never suppressed.

Null and empty texts have no words, no labels and score 0. Copies are judged alike. A long
text with many detections is handled by sorted running maxima, not by pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import spans, store

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stems of which every rule needs one.
GATE = r"(?i)licen|public[^a-z0-9]+domain|hereby[^a-z0-9]+granted|redistribution|all[^a-z0-9]+rights[^a-z0-9]+reserved"

# Licence families as label, keyword, names, identifiers (words, as patterns).
FAMILIES = [
    ("mit", "mit", "mit|expat", "mit"),
    ("apache", "apache", "apache|apache software", "apache"),
    ("gpl", "gpl", "gpl|gnu gpl", "gpl"),
    ("gpl", "general", "general public|gnu general public", "gpl"),
    ("lgpl", "lgpl", "lgpl|gnu lgpl", "lgpl"),
    ("lgpl", "lesser", "lesser general public|gnu lesser general public", "lgpl"),
    ("lgpl", "library", "library general public|gnu library general public", "lgpl"),
    ("agpl", "agpl", "agpl|gnu agpl", "agpl"),
    ("agpl", "affero", "affero general public|gnu affero general public", "agpl"),
    ("gfdl", "documentation", "free documentation|gnu free documentation", "gfdl"),
    ("bsd", "bsd", "bsd|new bsd|simplified bsd|modified bsd", "bsd"),
    ("mpl", "mozilla", "mozilla public", "mpl"),
    ("mpl", "mpl", "mpl", "mpl"),
    ("epl", "eclipse", "eclipse public", "epl"),
    ("cddl", "cddl", "cddl", "cddl"),
    ("cddl", "distribution", "common development and distribution", "cddl"),
    ("cc", "creative", "creative commons|creative commons attribution", "cc"),
    ("cc", "cc", "cc by|cc by sa|cc0", "cc by|cc0"),
    ("cc-nc", "nc", "cc by nc|cc by nc sa|cc by nc nd", "cc by nc"),
    ("cc-nc", "noncommercial", "creative commons attribution noncommercial", "cc by nc"),
    ("boost", "boost", "boost software", "bsl"),
    ("isc", "isc", "isc", "isc"),
    ("zlib", "zlib", "zlib|zlib libpng", "zlib"),
    ("artistic", "artistic", "artistic|clarified artistic", "artistic"),
    ("python", "python", "python software foundation|python", "python|psf"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("php", "php", "php", "php"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("eupl", "eupl", "eupl", "eupl"),
    ("eupl", "union", "european union public", "eupl"),
    ("ofl", "font", "open font|sil open font", "ofl"),
    ("odbl", "database", "open database", "odbl"),
    ("ms-pl", "microsoft", "microsoft public", "ms pl"),
    ("ms-rl", "reciprocal", "microsoft reciprocal", "ms rl"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("cecill", "cecill", "cecill", "cecill"),
    ("afl", "academic", "academic free", "afl"),
    ("ecl", "educational", "educational community", "ecl"),
    ("zpl", "zope", "zope public", "zpl"),
    ("unicode", "unicode", "unicode", "unicode"),
    ("w3c", "w3c", "w3c software", "w3c"),
]
# Openings of full texts and notices as label, keyword, words.
NOTICES = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("public-domain", "domain", "public domain"),
    ("public-domain", "domain", "released into the public domain"),
    ("public-domain", "dedicated", "dedicated to the public domain"),
    ("proprietary", "rights", "all rights reserved"),
]
# Base phrases, reported at every place.
BASE = [("mit", "mit", "mit license"), ("apache", "apache", "apache license"), ("gpl", "general", "general public license")]


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    pattern: str
    priority: int
    score: float
    base: bool = False
    #: Word sequences of which every match has one; no regex runs without it.
    needs: tuple[str, ...] = ()


def _seq(words: str) -> str:
    """Words of a phrase, each between two blanks."""
    return "".join(f" {w} " for w in words.split())


def _any(phrases: str) -> str:
    return "(?:" + "|".join(_seq(p) for p in sorted(phrases.split("|"), key=lambda p: (-len(p.split()), p))) + ")"


def _by_keyword(phrases: str, key: str) -> dict[str, str]:
    """The phrases by a word that each of them has: the family's keyword or else their last."""
    out: dict[str, list[str]] = {}
    for p in phrases.split("|"):
        out.setdefault(key if key in p.split() else p.split()[-1], []).append(p)
    return {k: "|".join(ps) for k, ps in out.items()}


def _glued(phrases: str) -> str:
    """Identifiers with the version in the same word, as in gplv3 and lgplv2.1."""
    return "(?:" + "|".join(_seq(p)[:-1] for p in sorted(phrases.split("|"), key=lambda p: (-len(p.split()), p))) + ")(?:v|ver|version)?[0-9]+ (?: [0-9]+ )?"


LICENSE, VERSION = "(?: license | licence )", "(?:(?: version | v )? [0-9]+ (?: [0-9]+ )?| v[0-9]+ (?: [0-9]+ )?)"
# Templates over a family: name, pattern of (names, identifiers), priority (1 is best), score.
TEMPLATES = [
    ("tag", lambda n, i: f" spdx  license  identifier {_any(i)}{VERSION}?", 1, 1.0),
    ("grant", lambda n, i: f"(?: licensed | released | distributed | available | provided | published ) under (?: the )?(?: terms  of )?(?: the )?{_any(n)}{LICENSE}(?:{VERSION})?", 2, 0.95),
    ("short_grant", lambda n, i: f"(?: licensed | licenced ) under (?: the )?{_any(n)}(?:{VERSION})?", 2, 0.95),
    ("version", lambda n, i: f"{_any(n)}{LICENSE}{VERSION}", 3, 0.9),
    ("address", lambda n, i: f"(?: opensource  org | spdx  org | gnu  org | apache  org | creativecommons  org ) licenses {_any(i)}", 3, 0.9),
    ("name", lambda n, i: f"{_any(n)}{LICENSE}", 4, 0.8),
    ("label", lambda n, i: f"{LICENSE}{_any(i)}", 5, 0.6),
]


# Templates over identifiers with a glued version: name, keyword, pattern, priority, score.
GLUED = [
    ("glued_tag", "identifier", lambda g: f" spdx  license  identifier {g}", 1, 1.0),
    ("glued_grant", "under", lambda g: f"(?: released | distributed | available | provided | published ) under (?: the )?(?: terms  of )?(?: the )?{g}{LICENSE}", 2, 0.95),
    ("glued_short", "under", lambda g: f"(?: licensed | licenced ) under (?: the )?(?: terms  of )?(?: the )?{g}(?:{LICENSE})?", 2, 0.95),
    ("glued_version", "license", lambda g: f"{g} license ", 3, 0.9),
    ("glued_version_c", "licence", lambda g: f"{g} licence ", 3, 0.9),
    ("glued_address", "licenses", lambda g: f"(?: opensource  org | spdx  org | gnu  org | apache  org | creativecommons  org ) licenses {g}", 3, 0.9),
    ("glued_label", "license", lambda g: f" license {g}", 5, 0.6),
    ("glued_label_c", "licence", lambda g: f" licence {g}", 5, 0.6),
]
#: Templates that are filled with identifiers; the others take names.
BY_ID = ("tag", "address", "label")


def rules() -> list[Rule]:
    """Families times templates, notices and base phrases: some 600 rules, one for each keyword of the alternatives."""
    out = [Rule(f"base.{k}", k, key, _seq(p), 4, 0.8, True, (_seq(p),)) for k, key, p in BASE]
    out += [Rule(f"notice.{i}", k, key, _seq(p), 2, 0.9 if k != "proprietary" else 0.5, needs=(_seq(p),)) for i, (k, key, p) in enumerate(NOTICES)]
    seen = set()
    for i, (label, key, names, ids) in enumerate(FAMILIES):
        made = []
        for t, make, pri, score in TEMPLATES:
            for word, phrases in _by_keyword(ids if t in BY_ID else names, key).items():
                made.append(Rule(f"{t}.{i}" + f".{word}" * (word != key), label, word, make(phrases, phrases), pri, score, needs=tuple(map(_seq, phrases.split("|")))))
        stems = tuple(_seq(p)[:-1] for p in ids.split("|"))
        made += [Rule(f"{t}.{i}", label, word, make(_glued(ids)), pri, score, needs=stems) for t, word, make, pri, score in GLUED]
        out += [r for r in made if (r.label, r.pattern) not in seen]
        seen |= {(r.label, r.pattern) for r in made}
    return out


def as_words(text: Column) -> Column:
    """Lower-cased words, each between two blanks; A-Z alone are folded."""
    flat = F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), GAP, "  "))
    return F.when(flat == "", F.lit("")).otherwise(F.concat(F.lit(" "), flat, F.lit(" ")))


def n_words(s: Column) -> Column:
    return ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("long")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", own: list[Rule] | None = None, out: str = "license") -> DataFrame:
    """All columns of docs and a struct: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    own = rules() if own is None else own
    table = F.array(*[F.struct(F.lit(r.keyword).alias("keyword"), F.lit(r.name).alias("name"), F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"),
                               F.lit(r.priority).alias("priority"), F.lit(r.score).alias("score"), F.lit(r.base).alias("base"),
                               F.array(*map(F.lit, r.needs)).cast("array<string>").alias("needs")) for r in own])
    whole = F.coalesce(F.col(text), F.lit(""))
    gated = docs.filter(F.col(text).rlike(GATE)).select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), as_words(whole).alias("_words"))
    has = lambda s: F.contains(F.col("_words"), s)
    may = lambda r: has(F.concat(F.lit(" "), r["keyword"], F.lit(" "))) & ((F.size(r["needs"]) == 0) | F.exists(r["needs"], has))
    near = gated.select("_key", "_hash", "_words", F.explode(F.filter(table, may)).alias("_rule"))
    near = near.withColumn("_rule", F.col("_rule").dropFields("needs"))
    found = near.select("_key", "_hash", "_rule", spans.parts(F.col("_words"), F.col("_rule.pattern"), n_words).alias("_parts")).filter(F.size("_parts") > 0)
    spots = spans.places(found.repartition("_key", "_hash"), ["_key", "_hash"], "_rule", "_parts", n_words).select(
        "_key", "_hash", "_rule.name", "_rule.label", "_rule.priority", "_rule.score", "_rule.base", "start", "end")
    earlier = Window.partitionBy("_key", "_hash").orderBy("start", F.desc("end"), "priority", "name").rowsBetween(Window.unboundedPreceding, -1)
    over = F.greatest(*[F.when(F.col("priority") >= p, F.coalesce(F.max(F.when(F.col("priority") <= p, F.col("end"))).over(earlier), F.lit(-1))).otherwise(F.lit(-1)) for p in sorted({r.priority for r in own})], F.lit(-1)) \
        if own else F.lit(-1)
    judged = spots.withColumn("kept", F.col("base") | (over < F.col("end")))
    best = judged.groupBy("_key", "_hash").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kept"), F.col("label")))), ",").alias("labels"),
        F.max(F.when(F.col("kept"), F.col("score"))).alias("score"))
    n, h = store.fresh(docs, "_n_words", "_text_hash")
    counted = docs.withColumns({n: F.regexp_count(whole, F.lit(WORD)).cast("long"), h: F.xxhash64(text)})
    joined = counted.join(best, counted[key].eqNullSafe(best["_key"]) & (counted[h] == best["_hash"]), "left")
    return joined.select(*store.own(counted, docs), F.struct(
        counted[n].alias("n_words"), F.coalesce(best["n_base"], F.lit(0)).cast("long").alias("n_base"), best["first_word"], best["last_word"],
        F.coalesce(best["base_labels"], F.lit("")).alias("base_labels"), F.coalesce(best["labels"], F.lit("")).alias("labels"), F.coalesce(best["score"], F.lit(0.0)).alias("score")).alias(out))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "license.*")


def sql() -> str:
    quoted = ", ".join(f"('{r.keyword}', '{r.name}', '{r.label}', '{r.pattern}', {r.priority}, {r.score}::double, {str(r.base).lower()})" for r in rules())
    return rf"""
with r(keyword, name, label, pattern, priority, score, base) as (values {quoted}),
d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, doc_id, text, len(regexp_extract_all(text, '{WORD}'))::bigint as n_words,
  trim(regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '{GAP}', '  ', 'g')) as flat from d),
n as (select rid, ' ' || flat || ' ' as s from w where regexp_matches(text, '{GATE}')),
h as (select rid, r.*, string_split_regex(s, pattern) as g, regexp_extract_all(s, pattern) as m from n, r
  where contains(s, ' ' || keyword || ' ') and regexp_matches(s, pattern)),
e as (select rid, name, label, priority, score, base, unnest(range(1, len(m) + 1)) as p, g, m from h),
x as (select *, (length(g[p]) - length(replace(g[p], ' ', ''))) // 2 as gw, (length(m[p]) - length(replace(m[p], ' ', ''))) // 2 as mw from e),
f as (select *, sum(gw + mw) over (partition by rid, name order by p) as "end" from x),
t as (select *, "end" - mw as start from f),
k as (select a.*, a.base or not exists (select 1 from t b where b.rid = a.rid and b.start <= a.start and b."end" >= a."end" and b.priority <= a.priority
  and (b.start < a.start or b."end" > a."end" or b.priority < a.priority or b.name < a.name)) as kept from t a),
o as (select rid, count_if(base) as n_base, min(case when base then start end)::bigint as first_word, max(case when base then start end)::bigint as last_word,
  array_to_string(list_sort(list_distinct(list(label) filter (where base))), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list(label) filter (where kept))), ',') as labels, max(score) filter (where kept) as score from k group by rid)
select doc_id, n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score from w left join o using (rid)
"""
