"""Terms and entities over whole documents, whatever stands between them."""

import math
import re

from shelfwise.llm import pii

from .test_pii import SF, brute, digits

TERM = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def whole_terms(rows, alpha=0.8, support=2):
    n, owners, both, having, free = len(rows), {}, {}, {}, []
    for _, text in rows:
        text = text or ""
        for t in {m[0].translate(pii._LOWER) for m in TERM.finditer(text) if len(m[0]) >= 3}:
            having[t] = having.get(t, 0) + 1
        spans = brute(text)
        own = {(k, text[s:e].translate(pii._LOWER) if k == "email" else text[s:e] if k == "ip" else digits(text[s:e])) for k, s, e in spans}
        found = [(m[0].translate(pii._LOWER), *m.span()) for m in TERM.finditer(text) if own and len(m[0]) >= 3 and not any(x < m.end() and y > m.start() for _, x, y in spans)]
        free.append((own, found))
        for x in own:
            owners[x] = owners.get(x, 0) + 1
            for t in {f[0] for f in found}:
                both[x, t] = both.get((x, t), 0) + 1
    told = {(e, t) for (e, t), c in both.items() if c >= support and owners[e] < n and math.log2(n * c / (owners[e] * having[t])) >= alpha * math.log2(n / owners[e]) - 1e-12}
    return [sorted((a, b) for t, a, b in found if any((e, t) in told for e in own)) for own, found in free]


def test_far_terms(spark):
    """On the line above, over 64 characters away, and again later in the document: all are marked."""
    far = "some plain words " * 10
    rows = [(1, "Name: Zorvax\nMail: z@x.com"), (2, f"z@x.com {far}\n\nquillon zorvax"), (3, f"Quillon {far} z@x.com {far} quillon\nZORVAX zorvax"), (4, "quillon alone"), (4, None)]
    rows += [(i, "some plain words") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(t.s, t.f) for t in r.terms] for r in pii.find(df).collect() if r.doc_id in (1, 2, 3)}
    assert got == {i + 1: x for i, x in enumerate(whole_terms(rows)[:3])} and len(got[3]) == 4
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert not any("zorvax" in clean[i].lower() or "quillon" in clean[i].lower() for i in (1, 2, 3)) and clean[10] == "some plain words"


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, ",".join(f"term:{a}:{b}" for a, b in x)) for (d, _), x in zip(rows, whole_terms(rows), strict=True))
    got = sorted((r.doc_id, ",".join(x for x in (r.spans or "").split(",") if x.startswith("term:"))) for r in pii.op9_pii(spark, SF).collect())
    assert got == want
