"""Licence scans: digests of canonical texts, looked up in a table of known ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideloom.llm.common import broadcast_small, table
from strideloom.llm.license_texts import EQUIVALENTS, LICENSES

#: Words after "copyright" in prose, where a line of a licence may break before it.
_PROSE = (
    r"(?:notices?|holders?|holder\(s\)|owners?|licen[cs]es?|laws?|statements?|interests?|protection|treat(?:y|ies)|permissions?|disclaimers?|information|rights?|material|claims?|status|"
    r"works?|infringement|ownership|doctrines?|resulting|including|each|and|or|in|on|to|if|is|are|of|for|as|that|the (?:software|library|program|work))\b")
#: Words of a licence that may follow a copyright notice on its line.
_OPENING = (
    r"\b(?:permission (?:is|to)|redistributions? (?:and|of|in)|(?:this|the) (?:software|program|library|work|file|source|code|package|product|document|font software|license) (?:is|are|may|can|comes|shall|must)|"
    r"(?:licensed|released|distributed|available|provided) under|everyone is|you (?:may|must|should|shall|can|are)|use of this|no part of|this is free|subject to|in no event|version [0-9])\b").replace(" ", r"[ \t]+")
_MARK = r"(?:\(c\)|©|[0-9]{4}|:|<|\[|\{)"
_LEAD = r"^[ \t*#/;!%-]*(?:(?:some[ \t]+)?(?:portions|parts)[ \t]+(?:of[ \t]+this[ \t]+\w+[ \t]+)?(?:are[ \t]+)?)?"
#: A line of lower-case text that begins with a copyright notice; one that goes on as prose; a notice amid a line; the licence words that end either. Java and RE2 read them alike.
NOTICE = rf"{_LEAD}(?:copyright(?:[ \t]*{_MARK}|[ \t]+[\p{{L}}\p{{N}}])|\(c\)[ \t]*[0-9]{{4}}|©|all[ \t]+rights[ \t]+reserved)"
SPEECH = rf"{_LEAD}copyright[ \t]+{_PROSE}"
AMID = rf"\bcopyright[ \t]*{_MARK}[\s\S]*$"
FROM = rf"{_OPENING}[\s\S]*$"
#: What a text with a notice holds.
SIGNS = ("copyright", "(c)", "©", "reserved")
#: Between a notice's place and the licence words that follow.
CUT = "\x02"
SPELLINGS = [*EQUIVALENTS, ("https", "http")]


def _bare_line(line: Column) -> Column:
    """A lower-case line without its notices: one that it begins with goes up to the line's end or the licence words on it, one amid it only if such words follow."""
    parts = F.split(F.regexp_replace(line, f"({_OPENING})", f"{CUT}$1"), CUT)
    amid = F.array_join(F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.regexp_replace(x, AMID, "")).otherwise(x)), " ")
    begins = line.rlike(NOTICE) & ~line.rlike(SPEECH)
    return F.when(begins, F.regexp_extract(line, FROM, 0)).when(reduce(lambda a, x: a | line.contains(x), SIGNS[1:], line.contains(SIGNS[0])), amid).otherwise(line)


def canonical(text: Column) -> Column:
    """Lower case, without copyright notices, what is neither letter nor digit as single spaces, one spelling of each word.

    A notice may be as long as its line. Null and blank texts give the empty string.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    signs = reduce(lambda a, x: a | low.contains(x), SIGNS[1:], low.contains(SIGNS[0]))
    t = F.when(signs, F.array_join(F.transform(F.split(low, "\n"), _bare_line), "\n")).otherwise(low)
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return F.btrim(reduce(lambda c, x: F.replace(c, F.lit(f" {x[0]} "), F.lit(f" {x[1]} ")), SPELLINGS, t))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id, digest of the texts that come with the package; any table of the same shape does."""
    texts = spark.createDataFrame(list(LICENSES.items()), "license_id string, text string")
    return texts.select("license_id", digest(F.col("text")).alias("digest"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs with ``canonical_sha256`` and ``license_id``, null where the entire text is no known licence.

    A digest known by several names gives the first of them. Only ids and digests would move if the
    registry were too large to broadcast. Null and blank texts match nothing, unless the registry has the
    empty digest. Repeated rows stay; an empty table gives no rows.
    """
    known = broadcast_small(known.groupBy(F.col("digest").alias("canonical_sha256")).agg(F.min("license_id").alias("license_id")))
    t = docs.drop("canonical_sha256", "license_id").withColumn("canonical_sha256", digest(F.col("text")))
    return t.join(known, "canonical_sha256", "left").select(*t.columns, "license_id")


def op8_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the known licences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, known_licenses(spark)).select("doc_id", "canonical_sha256", "license_id")


def _sql_canonical(source: str, key: str, text: str) -> str:
    """Tables that end in ``<source>_forms`` (key, digest) of the rows of ``source``, line by line."""
    signs = lambda x: "(" + " or ".join(f"contains({x}, '{s}')" for s in SIGNS) + ")"
    parts = f"string_split(regexp_replace(line, '({_OPENING})', chr(2) || '\\1', 'g'), chr(2))"
    line = f"""case when regexp_matches(line, '{NOTICE}') and not regexp_matches(line, '{SPEECH}') then regexp_extract(line, '{FROM}', 0)
      when {signs('line')} then array_to_string(list_transform({parts}, lambda x, i: case when i < len({parts}) then regexp_replace(x, '{AMID}', '') else x end), ' ') else line end"""
    spelt = f"' ' || regexp_replace(bare, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for a, b in SPELLINGS:
        spelt = f"replace({spelt}, ' {a} ', ' {b} ')"
    return f"""{source}_low as (select {key}, lower(coalesce({text}, '')) as low from {source}),
{source}_bare as (
  select {key}, case when {signs('low')} then array_to_string(list_transform(string_split(low, chr(10)), lambda line: {line}), chr(10)) else low end as bare from {source}_low),
{source}_forms as (select {key}, sha256(trim({spelt}, ' ')) as digest from {source}_bare)"""


def op8_sql() -> str:
    known = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in LICENSES.items())
    return f"""with registry as (select * from (values {known}) v(license_id, body)),
{_sql_canonical('registry', 'license_id', 'body')},
{_sql_canonical('documents', 'doc_id', 'text')},
known as (select digest, min(license_id) as license_id from registry_forms group by 1)
select doc_id, digest as canonical_sha256, license_id from documents_forms left join known using (digest)
"""
