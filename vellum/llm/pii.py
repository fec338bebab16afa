"""PII (operator 10): fixed patterns, and bootstrapped contextual extraction beyond them.

1. One scan of the whole texts finds the base entities (email, ip, card, phone) and secret-like strings (``_SECRET``: 20 or
   more characters of mixed letters and digits). These are the seed entities.
2. Seeds induce lexical patterns: a context (the one and the two words before, lower-cased, punctuation kept) and the
   shape of the entity (its kinds of characters, and for those with a digit also just that). A context is tried if ``SUPPORT`` different seeds follow it, and one more
   scan counts all that follows it anywhere: contexts followed by seeds less often than ``SHARE`` (stop words above
   all) say nothing and go.
3. A scan with the contexts left finds all that follows them, and Spark scores the bipartite graph of patterns and
   instances for ``ROUNDS`` rounds: a pattern's confidence is the mean score of its different instances, shrunk by ``PRIOR``
   doubtful ones; an instance's score is the noisy-or of its patterns' confidences; base entities stay at 1.
4. Instances that reach ``SURE`` are seeds of the next hop: another scan finds their other contexts, which may induce new
   patterns; hops end when no new context has support, after ``HOPS`` at most.
5. Sure instances become spans of kind ``id`` where they follow a context of one of their patterns: also a secret-like string
   counts only so. What a base kind's form has but its rule drops (a number that fails Luhn) is never an instance.

Contexts and instances go to scans in blocks of ``BLOCK``, as sets; occurrences are never compared with each other, and the
graph is aggregated with map-side combining, so a context as frequent as a third of all occurrences costs a row
an instance and task. Very long texts, words, and runs of digits are scanned in linear time.

Defined results: null text counts as empty; spans are in code points, end exclusive, base ones as the
patterns give them, and no other overlaps them; repeated rows give repeated rows with the same spans and count
once in the graph's different instances; ties in start are ordered by kind as listed; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import by_value, persist, table

KINDS = ("email", "ip", "card", "phone")
ROUNDS, HOPS, PRIOR, SUPPORT, SHARE, SURE, BLOCK = 3, 4, 2.0, 5, 0.2, 0.6, 100_000
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_RUN = re.compile(r"[0-9][\x20().0-9-]*+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_OPEN, _CLOSE = "\"'([{<#*$%&", ".,;:!?#*$%&\"')]}>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local characters before each @, not going back into the last match."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def _phones(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of +digit, some of the inner characters, digit; greedy to the last digit."""
    found, last, at = [], 0, text.find("+")
    while at >= 0:
        if at >= last:
            m = _RUN.match(text, at + 1)
            run = m.group().rstrip(" ().-") if m else ""
            if len(run) >= 3:
                last = at + 1 + len(run)
                found.append((at, last))
        at = text.find("+", at + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base entities, ordered by start, then kind as listed."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if any(d in text for d in "0123456789"):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40 and 12 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", a, b) for a, b in _phones(text) if 9 <= sum(c.isdigit() for c in text[a:b]) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def shape(entity: Column) -> Column:
    """The kinds of its characters: 9 for digits, a for letters, others themselves; in order, once each."""
    kind = lambda c: F.when((c >= "0") & (c <= "9"), "9").when(c.rlike(r"^\p{L}$"), "a").otherwise(c)
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(entity, ""), kind))), "")


def secrets(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _SECRET.finditer(text):
        digits = sum("0" <= c <= "9" for c in m.group())
        if digits >= 5 and sum(c.isalpha() for c in m.group()) >= 5:
            found.append(m.span())
    return found


def dropped(entity: str) -> bool:
    """It has a base kind's form and was left out by that kind's rule."""
    return bool(_IP.fullmatch(entity) or (_CARD.fullmatch(entity) and 12 <= sum(c.isdigit() for c in entity) <= 19))


class Words:
    """A text's words, lower-cased, with their places."""

    def __init__(self, text: str):
        spans = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.text = [a for a, _ in spans], text
        self.ends, self.low = [b for _, b in spans], [text[a:b].lower() for a, b in spans]

    def contexts(self, k: int) -> list[str]:
        """What stands before word ``k``: one word, and two."""
        return [" ".join(self.low[k - n : k]) for n in (1, 2) if k >= n]

    def holding(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def entity(self, k: int) -> tuple[int, int]:
        """Word ``k`` without punctuation around it."""
        word = self.text[self.starts[k] : self.ends[k]]
        left = len(word) - len(word.lstrip(_OPEN))
        word = word[left:].rstrip(_CLOSE)
        return self.starts[k] + left, self.starts[k] + left + len(word)


def _scan(batches):
    """Base entities of each text, and the contexts of all seeds."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    seed = pa.struct([("instance", pa.string()), ("base", pa.bool_()), ("contexts", pa.list_(pa.string()))])
    for batch in batches:
        counts, spans, found = [], [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            taken = [(a, b) for _, a, b in base]
            hidden = [x for x in secrets(text or "") if not any(a < x[1] and x[0] < b for a, b in taken)]
            words = Words(text) if taken or hidden else None
            counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
            spans.append([{"kind": KINDS.index(k), "start": a, "end": b} for k, a, b in base])
            found.append([{"instance": text[a:b], "base": n < len(taken), "contexts": words.contexts(words.holding(a))} for n, (a, b) in enumerate(taken + hidden)])
        shas = [hashlib.sha256(joined((KINDS[x["kind"]], x["start"], x["end"]) for x in s).encode()).hexdigest() for s in spans]
        arrays = [batch.column("doc_id"), batch.column("text_hash"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(shas, pa.string())]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(seed))], names=["doc_id", "text_hash", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "seeds"])


def _followed(contexts: frozenset):
    """How often anything follows these contexts."""
    last = frozenset(c.rpartition(" ")[2] for c in contexts)

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                low = [w.lower() for w in _WORD.findall(text or "")]
                for k, w in enumerate(low[:-1]):
                    if w in last:
                        seen.update(c for c in (w, " ".join(low[k - 1 : k + 1]) if k else "") if c in contexts)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["context", "n"])

    return run


def _found(contexts: frozenset, instances: frozenset):
    """Words that follow one of the contexts, or are one of the instances, with all their contexts."""
    last = frozenset(c.rpartition(" ")[2] for c in contexts)

    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [], [])
            for doc, code, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                text = text or ""
                if any(w.lower() in last or w.lstrip(_OPEN).rstrip(_CLOSE) in instances for w in _WORD.findall(text)):
                    words, taken = Words(text), None
                    for k in range(len(words.low)):
                        before = words.contexts(k) if instances or (k and words.low[k - 1] in last) else []
                        a, b = words.entity(k) if before else (0, 0)
                        if a < b and (any(c in contexts for c in before) or text[a:b] in instances):
                            if taken is None:
                                taken = [(x, y) for _, x, y in base_spans(text)]
                            at = bisect_right(taken, (b,))
                            if not any(a < y and x < b for x, y in taken[max(0, at - 4) : at]) and not dropped(text[a:b]):
                                for column, x in zip(out, (doc, code, a, b, text[a:b], before), strict=True):
                                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "text_hash", "start", "end", "instance", "contexts"])

    return run


def _sets(df: DataFrame):
    """The values of a one-column table as sets of at most about ``BLOCK``."""
    name = df.columns[0]
    parts = -(-df.count() // BLOCK)
    for k in range(parts):
        yield frozenset(r[0] for r in df.where(F.pmod(F.xxhash64(name), F.lit(parts)) == k).collect())


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.limit(0)
    for p in parts:
        out = out.unionByName(p)
    return out


def score(edges: DataFrame) -> DataFrame:
    """``edges (pattern, instance, base)``, distinct, to ``instance, base, score, pattern, confidence``: a row an edge."""
    known = edges.withColumn("score", F.when(F.col("base"), 1.0).otherwise(F.col("prior")))
    for _ in range(ROUNDS):
        patterns = known.groupBy("pattern").agg((F.sum("score") / (F.count("*") + PRIOR)).alias("confidence"), F.sum("score").alias("support"))
        sure = F.when(F.col("support") >= SUPPORT, F.least("confidence", F.lit(0.999))).otherwise(0.0)
        judged = edges.join(patterns.select("pattern", sure.alias("confidence")), "pattern")
        scores = judged.groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("own"))
        known = persist(judged.join(scores, "instance").withColumn("score", F.when(F.col("base"), 1.0).otherwise(F.col("own"))).drop("own"), "scored")
    return known


def _shapes(instance: Column) -> Column:
    """An instance's own shape and, if it has a digit, that of all that have."""
    own = F.array(shape(instance))
    return F.when(instance.rlike("[0-9]"), F.array_append(own, F.lit("with a digit"))).otherwise(own)


def sure_spans(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``doc_id, text_hash, start, end`` of what the bootstrapped patterns find. ``docs`` has ``doc_id, text_hash, text``,
    ``seeds`` is (``instance, base, contexts``)."""
    induced = persist(seeds.select("instance", "base", F.explode("contexts").alias("context")).groupBy("context", "instance").agg(F.max("base").alias("base"), F.count("*").alias("n")), "induced")
    tried = good = places = None
    for _ in range(HOPS):
        backed = induced.groupBy("context").agg(F.count("*").alias("support"), F.sum("n").alias("n_seeds")).where(F.col("support") >= SUPPORT)
        new = persist(backed if tried is None else backed.join(tried.select("context"), "context", "left_anti"), "contexts")
        if new.isEmpty():
            break
        tried = new if tried is None else tried.unionByName(new)
        counts = [docs.select("text").mapInArrow(_followed(block), "context string, n long") for block in _sets(new.select("context"))]
        counted = _union(counts, counts[0]).groupBy("context").agg(F.sum("n").alias("n"))
        telling = persist(new.join(counted, "context").where(F.col("n_seeds") >= SHARE * F.col("n")).select("context"), "telling")
        if telling.isEmpty():
            break
        good = telling if good is None else good.unionByName(telling)
        hits = [docs.mapInArrow(_found(block, frozenset()), "doc_id long, text_hash long, start int, end int, instance string, contexts array<string>") for block in _sets(telling)]
        hits = persist(_union(hits, hits[0]), "hits")
        places = hits if places is None else places.unionByName(hits)
        # the graph: what follows a telling context, and the base entities that do
        own = seeds.where("base").select("instance", F.explode("contexts").alias("context"), F.lit(True).alias("base"))
        edges = places.select("instance", F.explode("contexts").alias("context"), F.lit(False).alias("base")).unionByName(own).join(good, "context", "left_semi")
        edges = edges.groupBy("context", "instance").agg(F.max("base").alias("base"))
        known = seeds.where("NOT base").select("instance").distinct().withColumn("prior", F.lit(1.0))
        edges = edges.join(known, "instance", "left").withColumns({"prior": F.coalesce("prior", F.lit(0.0)), "shape": F.explode(_shapes(F.col("instance")))})
        edges = edges.withColumn("pattern", F.concat_ws("\x1f", "context", "shape"))
        graph = score(persist(edges.select("pattern", "instance", "base", "prior"), "graph"))
        sure = persist(graph.where((~F.col("base")) & (F.col("score") >= SURE)).select("instance").distinct(), "sure")
        more = [docs.mapInArrow(_found(frozenset(), block), "doc_id long, text_hash long, start int, end int, instance string, contexts array<string>") for block in _sets(sure)]
        if not more:
            break
        again = _union(more, more[0]).select("instance", F.lit(False).alias("base"), F.explode("contexts").alias("context"))
        again = again.groupBy("context", "instance").agg(F.max("base").alias("base"), F.count("*").alias("n"))
        induced = persist(induced.unionByName(again).groupBy("context", "instance").agg(F.max("base").alias("base"), F.max("n").alias("n")), "induced")
    if places is None:
        return docs.limit(0).selectExpr("doc_id", "text_hash", "0 as start", "0 as end")
    follows = places.select("doc_id", "text_hash", "start", "end", "instance", F.explode("contexts").alias("context")).join(good, "context", "left_semi")
    return follows.join(sure, "instance", "left_semi").select("doc_id", "text_hash", "start", "end").distinct()


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    seed = "array<struct<instance:string,base:boolean,contexts:array<string>>>"
    schema = "doc_id long, text_hash long, " + ", ".join(f"n_{k} long" for k in KINDS) + f", base_sha256 string, base array<struct<kind:int,start:int,end:int>>, seeds {seed}"
    rows = persist(texts.mapInArrow(_scan, schema), "scanned")
    spans = sure_spans(texts, rows.select(F.explode("seeds").alias("s")).select("s.*"))
    new = spans.groupBy(F.col("doc_id").alias("new id"), F.col("text_hash").alias("new hash")).agg(F.collect_list(F.struct(F.lit(len(KINDS)).alias("kind"), "start", "end")).alias("new"))  # of one text
    new = persist(new, "new-spans")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    both = rows.join(new, rows["doc_id"].eqNullSafe(new["new id"]) & (rows["text_hash"] == new["new hash"]), "left").withColumn("all", F.concat("base", F.coalesce("new", none)))
    ordered = F.sort_array(F.transform("all", lambda s: F.struct(s["start"], s["kind"], s["end"])))
    names = F.array(*[F.lit(k) for k in (*KINDS, "id")])
    spans = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return both.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


by_value(__name__)
