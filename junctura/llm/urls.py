"""URL filters: a weighted vocabulary of strict and soft terms.

The vocabulary is a table of terms, weights and kinds (`url_terms.csv`, or any other). An Aho-Corasick
automaton finds every term in the lower-cased url; a hit counts only between boundaries (an end of the
url or a character that is no letter or digit). One strict term rejects, and so do soft terms whose
weights, each different term counting once, reach ``soft_weight``; no weight of theirs exceeds 1, so at
a soft weight of 2 that takes several. Rules on host and path come first; the longest that fits decides.

Defined cases: a null url, or one without "://", has an empty host and path; a null url has no terms;
very long urls are searched whole; repeated rows are judged one by one; extra columns pass through
unless they bear an output's name.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator
from pathlib import Path

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.scratch import free_name

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (term, weight, kind)
Vocabulary = tuple[tuple[str, float, str], ...]


def vocabulary(path: str | None = None) -> Vocabulary:
    """The terms of a csv file with the columns term, weight and kind (strict or soft); the production filter's by default."""
    with (Path(path) if path else Path(__file__).with_name("url_terms.csv")).open(encoding="utf-8", newline="") as file:
        return checked((r["term"], float(r["weight"]), r["kind"]) for r in csv.DictReader(file))


def checked(terms: Iterable[tuple[str, float, str]]) -> Vocabulary:
    """The terms in lower case, each once, with weights above 0 (of soft ones, to 1)."""
    out = tuple((t.lower(), float(w), kind) for t, w, kind in terms)
    if len({t for t, _, _ in out}) < len(out) or any(not t or w <= 0 or kind not in ("strict", "soft") or (kind == "soft" and w > 1) for t, w, kind in out):
        raise ValueError("a url vocabulary needs different terms, each strict or soft, with weights above 0 and at most 1")
    return out


#: (host, path, verdict) of the production rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path), and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def term_hits(terms: Vocabulary):
    """A column function: (number of different strict terms, weight of the different soft terms) in a url."""

    @F.pandas_udf("struct<strict: int, soft: double>")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = ahocorasick.Automaton()
        for term, weight, kind in terms:
            found.add_word(term, (term, weight, kind == "strict"))
        if terms:
            found.make_automaton()
        table = str.maketrans(_UPPER, _LOWER)
        plain = set(_LOWER + "0123456789")
        for series in urls:
            rows = []
            for url in series:
                seen: dict[str, tuple[float, bool]] = {}
                if url and terms:
                    low = url.translate(table)
                    for end, (term, weight, strict) in found.iter(low):
                        start = end - len(term)
                        if (start < 0 or low[start] not in plain) and (end + 1 == len(low) or low[end + 1] not in plain):
                            seen[term] = (weight, strict)
                rows.append((sum(s for _, s in seen.values()), sum(sorted(w for w, s in seen.values() if not s))))
            yield pd.DataFrame(rows, columns=["strict", "soft"]).astype({"strict": "int32", "soft": "float64"})

    return hits


def filter_urls(pages: DataFrame, soft_weight: float = 2.0, terms: Vocabulary | None = None, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, strict_terms, soft_weight and verdict."""
    added = ("host", "path", "rule", "strict_terms", "soft_weight", "verdict")
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    hits = term_hits(vocabulary() if terms is None else checked(terms))
    parts = pages.select(*[c for c in pages.columns if c.lower() not in added], host.alias("host"), path.alias("path"))
    found = free_name(parts, "_hits")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.withColumn(found, hits("url")).withColumn("rule", rule)
    own = F.when((F.col(f"{found}.strict") > 0) | (F.col(f"{found}.soft") >= soft_weight), "block").otherwise("allow")
    return judged.select("*", F.col(f"{found}.strict").alias("strict_terms"), F.col(f"{found}.soft").alias("soft_weight"), F.coalesce(said, own).alias("verdict")).drop(found)


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def reference_sql(soft_weight: float = 2.0) -> str:
    low = f"translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}')"
    hit = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    strict = " OR ".join(hit(t) for t, _, kind in vocabulary() if kind == "strict")
    soft = " + ".join(f"CASE WHEN {hit(t)} THEN {w} ELSE 0 END" for t, w, kind in vocabulary() if kind == "soft")
    whens = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in whens]
    return f"""
WITH a AS (SELECT page_id, {low} AS u, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)} END AS rule,
  CASE {' '.join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)}
    WHEN {strict} OR {soft} >= {soft_weight} THEN 'block' ELSE 'allow' END AS verdict
FROM b"""
