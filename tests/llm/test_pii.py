import hashlib
import random
import re

from vellum.llm import pii as P


def brute(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and P.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], P.KINDS.index(x[0])))


def test_base_spans_against_plain_patterns():
    rng = random.Random(2)
    for alphabet in ("a1.@-+ ", "0123456789 -.", "+0123 ().-x", "ab.@c-%é\n", "1.2@3+4 "):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert P.base_spans(text) == brute(text), text
    assert P.base_spans("card 4539-1488 0343 6467, 0000000.1.1.255") == [("card", 5, 24), ("ip", 26, 41)]
    for long in ("1" * 300_000, "a" * 300_000, "1." * 100_000, "+1 " * 100_000, "a@" * 100_000):
        P.base_spans(long), P.secrets(long), P.Words(long)


def test_small_cases(spark):
    rows = [(0, None), (1, ""), (None, "mail a.b@c.de")]
    rows += [(10 + k, f"some text id: 10.0.0.{k} then more {k}{k}") for k in range(30)]
    rows += [(50, "new id: 9912-AB77 here"), (51, "cost was 12345 euros"), (52, "more"), (50, "new id: 9912-AB77 here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as spans", "2 as base")
    got = P.find(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(P.joined(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x[0] == k for x in want) for k in P.KINDS]
        assert {P.joined([x]) for x in want} <= set(r.spans.split(","))
    assert [r.spans for r in got if r.doc_id == 50] == ["id:8:17"] * 2 and [r.spans for r in got if r.doc_id in (51, 52)] == ["", ""]
    assert P.find(docs.limit(0)).count() == 0


def spans_of(spark, rows):
    return {r.doc_id: r.spans for r in P.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_planted_identifiers(spark):
    """Two kinds of identifiers, one led to by base entities, one only by what was found first; all of them, and nothing else."""
    rng, rows, planted = random.Random(4), [], {}
    noise = lambda: " ".join(rng.choice(("the", "of", "in", "and", "was", "plain")) for _ in range(rng.randrange(3, 9)))
    add = lambda text, found=None: (rows.append((len(rows), text)), planted.update({len(rows) - 1: found} if found else {}))
    for k in range(20):  # base entities after a telling word, and after any word
        add(f"{noise()} host 10.0.0.{k} {noise()}")
        add(f"{noise()} 10.9.0.{k} {noise()}")
    for k in range(8):  # identifiers after the same word; later they stand after another one
        add(f"{noise()} host srv-{k}0 {noise()}", f"srv-{k}0")
        add(f"{noise()} machine srv-{k}0, {noise()}", f"srv-{k}0")
    for k in range(6):
        add(f"{noise()} machine lab-{k}7 {noise()}", f"lab-{k}7")
    for k in range(60):  # numbers after words that say nothing, numbers that fail the card rule
        add(f"{noise()} the {k}{k} of {1000 + k}-{k} in {noise()}")
        add(f"{noise()} host 4539148803436468 {noise()}")
    got = spans_of(spark, rows)
    for i, text in rows:
        found = [text[int(a) : int(b)] for kind, a, b in (x.split(":") for x in got[i].split(",") if x) if kind == "id"]
        assert found == ([planted[i]] if i in planted else []), text


def test_graph_against_plain_python(spark):
    rng = random.Random(8)
    edges = sorted({(f"p{rng.randrange(6)}", f"i{rng.randrange(25)}") for _ in range(90)})
    base = {f"i{k}" for k in range(9)}
    prior = {f"i{k}": 1.0 for k in range(9, 12)}
    want = {i: 1.0 if i in base else prior.get(i, 0.0) for _, i in edges}
    for _ in range(P.ROUNDS):
        conf = {}
        for p in {p for p, _ in edges}:
            got = [want[i] for q, i in edges if q == p]
            conf[p] = min(sum(got) / (len(got) + P.PRIOR), 0.999) if sum(got) >= P.SUPPORT - 1e-9 else 0.0
        doubt = dict.fromkeys(want, 1.0)
        for p, i in edges:
            doubt[i] *= 1 - conf[p]
        want = {i: 1.0 if i in base else 1 - d for i, d in doubt.items()}
    df = spark.createDataFrame([(p, i, i in base, prior.get(i, 0.0)) for p, i in edges], "pattern string, instance string, base boolean, prior double")
    got = {r.instance: r.score for r in P.score(df).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_secrets_of_the_whole_table(spark):
    """Every quoted secret after its cue is found, and no more (the tables plant them as token = "..." alone)."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in P.op10(spark, sf).collect():
        want = [f"id:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', texts[r.doc_id])]
        assert [x for x in r.spans.split(",") if x.startswith("id:")] == want


def test_very_long_text(spark):
    rows = [(k, f"id: 10.0.0.{k} and") for k in range(12)] + [(50, "word " * 60_000 + "id: ZX-991 " + "1" * 200_000)]
    at = 5 * 60_000 + 4
    assert spans_of(spark, rows)[50] == f"id:{at}:{at + 6}"


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = P.op10(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(P.joined(want).encode()).hexdigest() and [r[f"n_{k}"] for k in P.KINDS] == [sum(x[0] == k for x in want) for k in P.KINDS]
