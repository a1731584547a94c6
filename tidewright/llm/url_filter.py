"""Operator 7: URL rules and a weighted vocabulary searched by Aho-Corasick."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path). A rule fits its host and all subdomains when the path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: One of these rejects a URL.
STRICT = (
    "adult", "bordell", "camgirl", "casino", "escort", "gambling", "hentai", "malware", "nude", "phishing",
    "porn", "porno", "sex", "sexe", "sexo", "spam", "viagra", "warez", "xxx",
)
#: Two different ones of these reject a URL.
SOFT = (
    "ads", "adserver", "bet", "bets", "bonus", "buy", "cheap", "click", "crack", "deal", "deals", "dating", "discount",
    "farm", "free", "hot", "jackpot", "keygen", "loan", "loans", "lottery", "lucky", "pharma", "pill", "pills", "poker",
    "popup", "promo", "slots", "torrent", "track", "tracker", "tracking", "win", "winner", "x18",
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits. A rule's name is its host and path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for does, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(does)).otherwise(verdict)
    return rule, verdict


class Vocabulary:
    """Weighted terms, searched in one pass. A term counts where no ASCII letter or digit touches it.

    One strict term rejects a text; of the soft terms, those that differ add up their weights, 1 unless told otherwise, and
    reject it at the limit.
    """

    def __init__(self, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: float = 2, weights: dict[str, float] | None = None):
        self.strict, self.soft, self.soft_limit = strict, soft, soft_limit
        self.weights = {t: (weights or {}).get(t, 1) for t in soft}
        self._automaton = None

    @classmethod
    def from_table(cls, terms: DataFrame, limit: float = 2, term_col: str = "term", weight_col: str = "weight", most: int = 1_000_000) -> Vocabulary:
        """A vocabulary of the rows (term, weight); terms of at least the limit's weight are strict.

        Terms are lower-cased (A-Z); of one that is repeated the largest weight counts, and empty or null terms and weights
        of 0 or less, or null, are left out. A vocabulary goes to every task, so more than `most` terms are an error.
        """
        rows = terms.select(F.translate(F.col(term_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("t"), F.col(weight_col).cast("double").alias("w"))
        found = rows.where("t <> '' AND w > 0").groupBy("t").agg(F.max("w").alias("w")).limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"a vocabulary has at most {most} terms")
        by_term = {r["t"]: r["w"] for r in sorted(found)}
        return cls(tuple(t for t, w in by_term.items() if w >= limit), tuple(t for t, w in by_term.items() if w < limit), limit, by_term)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def found(self, text: str) -> tuple[int, set[str]]:
        """(strict terms found, different soft terms) in a text, A-Z lower-cased."""
        import ahocorasick

        if self._automaton is None:
            built = ahocorasick.Automaton()
            for t in (*self.soft, *self.strict):
                built.add_word(t, (t not in self.weights or t in self.strict, t))
            built.make_automaton()
            self._automaton = built
        strict, soft = 0, set()
        if not len(self._automaton):
            return strict, soft
        for end, (is_strict, term) in self._automaton.iter(text):
            start = end - len(term) + 1
            if (start and text[start - 1] in WORDY) or (end + 1 < len(text) and text[end + 1] in WORDY):
                continue
            if is_strict:
                strict += 1
            else:
                soft.add(term)
        return strict, soft

    def hits(self, text: str) -> tuple[int, int]:
        """(strict terms found, different soft terms found)."""
        strict, soft = self.found(text)
        return strict, len(soft)

    def rejects(self, text: str) -> bool:
        strict, soft = self.found(text)
        return strict > 0 or sum(self.weights[t] for t in soft) >= self.soft_limit

    def sql(self, text: str) -> str:
        """The same decision as a DuckDB expression over an SQL text expression."""
        edge = lambda t: f"regexp_matches({text}, '(^|[^a-z0-9])({t})([^a-z0-9]|$)')"
        soft = " + ".join(f"CAST({edge(re.escape(t))} AS INTEGER)" + (f" * {w}" if w != 1 else "") for t, w in self.weights.items())
        return f"({edge('|'.join(map(re.escape, self.strict)))} OR {soft} >= {self.soft_limit})"


WORDY = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def judge_urls(pages: DataFrame, rules: tuple = RULES, vocabulary: Vocabulary | None = None, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, strict_hits, soft_hits and verdict (allow or block).

    The longest fitting rule decides; a URL that none fits is blocked when the vocabulary rejects its host and path. A
    null URL and one without `://` have an empty host and path and are allowed. Rules of the same length rank by their
    text. Rows are judged alone, so repeated rows agree; a long URL is searched whole in one pass. An empty table gives an
    empty result. Columns of the added names are replaced, all others stay.
    """
    vocabulary = vocabulary or Vocabulary()
    added = ("host", "path", "rule", "strict_hits", "soft_hits", "verdict")
    others = [c for c in pages.columns if c not in added]
    host, path = host_of(pages[url_col]), path_of(pages[url_col])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(*others, host.alias("host"), path.alias("path")).withColumns({"rule": rule, "verdict": verdict})
    schema = rows.select(*others, "host", "path", "rule").schema.add("strict_hits", "integer").add("soft_hits", "integer").add("verdict", "string")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        n = len(others)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                b = batch.slice(k, 1024)
                found = [vocabulary.found((h + p).translate(lower)) for h, p in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
                bad = [strict > 0 or sum(vocabulary.weights[t] for t in soft) >= vocabulary.soft_limit for strict, soft in found]
                said = [v or ("block" if x else "allow") for v, x in zip(b.column(n + 3).to_pylist(), bad, strict=True)]
                columns = [pa.array([strict for strict, _ in found], pa.int32()), pa.array([len(soft) for _, soft in found], pa.int32())]
                yield pa.record_batch([*b.columns[: n + 3], *columns, pa.array(said, pa.string())], names=schema.names)

    return rows.mapInArrow(judge, schema)


def oracle(vocabulary: Vocabulary | None = None, rules: tuple = RULES) -> str:
    """DuckDB SQL for (page_id, host, path, rule, verdict) of the table pages."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2]))
    fits = lambda h, p: f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    said = " ".join(f"WHEN {fits(h, p)} THEN '{does}'" for does, h, p in ordered)
    low = "translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {said} WHEN {(vocabulary or Vocabulary()).sql(low)} THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""
