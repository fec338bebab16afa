"""Quality rules (operator 8): document rules, and verdicts on whole hosts from shrunk failure rates.

Document rules use counts of each whole text. Hosts (``source``) are judged by how many of their
documents fail: rates are shrunk by a beta prior fitted to all hosts by moments (weighted by
documents), and a host falls only if the failure rate's posterior mean less ``BOUND`` standard
deviations exceeds ``HOST_LIMIT``, that is, if nearly all of its documents surely fail. All
documents of a fallen host go.

Only built-in DataFrame functions run. A document's repeated windows are found inside its row: window
hashes are sorted, equal neighbours give the repeated ones, and positions are counted without
comparing pairs. Host sums combine map-side, so a host with a third of all documents costs one
partial row a task; only fallen hosts are joined back (broadcast up to ``MOST_HOSTS``, else shuffled).

Defined results: null text has no words (and so fails); a null host is a host of its own; repeated
rows are judged and counted separately; an empty table gives an empty result; ``judge`` ignores
extra columns and ``keep`` keeps them, whatever their names; a very long text is judged whole, in time n log n of its
words; hosts with equal rates stand or fall together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import SPACE, WORD, bounded, free_name, let, persist, table

MIN_WORDS, MOST_REPEATED = 50, 50  # words; percent of words in repeated windows
WINDOW, HOST_LIMIT, BOUND, MOST_HOSTS = 3, 0.9, 2.0, 10_000
MANY = 64


def _windows(words: Column, width: int) -> Column:
    """64-bit hash of each window of ``width`` words, in order."""
    starts = F.sequence(F.lit(0), F.size(words) - width)
    hashed = F.transform(starts, lambda k: F.xxhash64(*[F.get(words, k + j) for j in range(width)]))
    return F.when(F.size(words) >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def _repeated_at(windows: Column, again: Column) -> Column:
    """Ascending positions of the windows whose hash is in ``again``: by looking each up where that
    list is short, else by sorting (hash, position) pairs."""
    none = F.array().cast("array<int>")
    listed = F.filter(F.transform(windows, lambda x, k: F.when(F.array_contains(again, x), k)), lambda k: k.isNotNull())
    pairs = F.sort_array(F.transform(windows, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))

    def in_runs(p: Column) -> Column:
        same = lambda e, k: F.get(p, k)["h"].eqNullSafe(e["h"])
        return F.transform(F.filter(p, lambda e, k: same(e, k + 1) | same(e, k - 1)), lambda e: e["k"])

    return F.when(F.size(again) == 0, none).when(F.size(again) <= MANY, listed).otherwise(F.sort_array(let(pairs, in_runs)))


def _covered(positions: Column) -> Column:
    """Words covered by windows at these ascending positions."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    more = lambda acc, k: F.struct((acc["n"] + F.least(F.lit(WINDOW), k - acc["last"])).alias("n"), k.alias("last"))
    return F.aggregate(positions, start, more, lambda acc: acc["n"])


def _repeated_words(words: Column) -> Column:
    def of_windows(windows: Column) -> Column:
        doubles = let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda x, k: x.eqNullSafe(F.get(s, k - 1)))))
        return let(doubles, lambda again: _covered(_repeated_at(windows, again)))

    return let(_windows(words, WINDOW), of_windows)


def rule_counts(text: Column) -> Column:
    """Struct of the rules' counts of a text and ``failed``; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def of_words(w: Column) -> Column:
        n = F.size(w).cast("long")
        return let(
            _repeated_words(w),
            lambda repeated: F.struct(
                n.alias("n_words"),
                (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeated.alias("n_repeat_words"),
                ((n < MIN_WORDS) | (100 * repeated > MOST_REPEATED * n)).alias("failed"),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)


def rule_failed(text: Column) -> Column:
    """``failed`` of ``rule_counts`` alone: words are counted first, and windows only where there are enough."""
    def of_words(w: Column) -> Column:
        n = F.size(w).cast("long")
        return F.when(n < MIN_WORDS, True).otherwise(100 * _repeated_words(w) > MOST_REPEATED * n)

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), of_words)


def fallen_hosts(judged: DataFrame, host: str = "source", failed: str = "failed") -> DataFrame:
    """``fallen_host`` of the hosts whose documents surely fail, by the shrunk rates."""
    hosts = persist(judged.groupBy(F.col(host).alias("fallen_host")).agg(F.count("*").alias("n"), F.count_if(failed).alias("k")), "hosts")
    # the prior by moments: mean m and between-host variance of the rates, each host weighted by its n
    n, k, h, squares = hosts.agg(F.sum("n"), F.sum("k"), F.count("*"), F.sum(F.col("k") * F.col("k") / F.col("n"))).first()
    m = min(max((k or 0) / max(n or 0, 1), 1e-3), 1 - 1e-3)
    scatter = (squares or 0.0) - (n or 0) * m * m  # sum of n (rate - m)^2
    spread = max(n or 0, 1) - (hosts.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) / max(n or 0, 1)
    between = max((scatter - max((h or 1) - 1, 0) * m * (1 - m)) / max(spread, 1e-9), 1e-6)
    strength = min(max(m * (1 - m) / between - 1, 2.0), 1000.0)
    a, b = m * strength + F.col("k"), (1 - m) * strength + F.col("n") - F.col("k")
    rate = a / (a + b)
    low = rate - BOUND * F.sqrt(rate * (1 - rate) / (a + b + 1))
    return persist(hosts.where(low > HOST_LIMIT).select("fallen_host"), "fallen")


def _joined(rows: DataFrame, fallen: DataFrame, host: str, how: str) -> DataFrame:
    """Rows of fallen hosts (``left_semi``) or of the others (``left_anti``)."""
    marked = fallen.select(F.col("fallen_host").alias("fallen host"))
    marked = F.broadcast(marked) if bounded(marked, MOST_HOSTS) else marked
    return rows.join(marked, rows[host].eqNullSafe(marked["fallen host"]), how)


def judge(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, host``."""
    rows = persist(docs.select("doc_id", F.col("source").alias("host"), rule_counts(F.col("text")).alias("rule")).select("doc_id", "host", "rule.*"), "counts")
    fallen = fallen_hosts(rows, "host").withColumnRenamed("fallen_host", "fallen host")
    fallen = F.broadcast(fallen) if bounded(fallen, MOST_HOSTS) else fallen
    rows = rows.join(fallen.withColumn("falls", F.lit(True)), rows["host"].eqNullSafe(fallen["fallen host"]), "left")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *counts, F.col("failed").alias("base_failed"), (~F.col("failed") & F.col("falls").isNull()).alias("kept"), "host")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass. Texts are judged twice, for the hosts' counts and for the rows that stay, and never
    written on the way: a copy with the flag would lie beside the output for as long as anything reads it."""
    failed = free_name(docs, "rule_failed")
    fallen = fallen_hosts(docs.select("source", rule_failed(F.col("text")).alias(failed)), "source", failed)
    return _joined(docs.where(~rule_failed(F.col("text"))), fallen, "source", "left_anti").select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("host")
