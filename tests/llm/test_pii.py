import hashlib
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import pii

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x // 10 + x % 10
    return t % 10 == 0


OK = {
    "email": lambda s: True,
    "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
    "card": lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s)),
    "phone": lambda s: 9 <= len(digits(s)) <= 15,
}


def brute(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if OK[k](m[0])]


@given(st.text(alphabet="a.@-+ 019()é%\n", max_size=60))
@settings(max_examples=600, deadline=None)
def test_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_known():
    text = "Mail a.b+c@x-y.co.uk, é 010.1.2.255 and 1.2.3.256, 4111 1111-1111 1111; +1 (555) 010-9999."
    assert pii.base_spans(text) == brute(text) and {k for k, _, _ in pii.base_spans(text)} == set(pii.KINDS)
    assert pii.base_spans("1" * 200000 + "@" * 1000) == []


def brute_terms(rows, alpha=0.8, support=2):
    term = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
    n, owners, both, having, near = len(rows), {}, {}, {}, {}
    for i, (_, text) in enumerate(rows):
        text = text or ""
        for t in {m[0].translate(pii._LOWER) for m in term.finditer(text) if len(m[0]) >= 3}:
            having[t] = having.get(t, 0) + 1
        spans = brute(text)
        seen_e, seen_p = set(), set()
        for k, s, e in spans:
            v = text[s:e].translate(pii._LOWER) if k == "email" else text[s:e] if k == "ip" else digits(text[s:e])
            seen_e.add((k, v))
            for m in term.finditer(text):
                a, b = m.span()
                if len(m[0]) >= 3 and not any(x < b and y > a for _, x, y in spans):
                    t = m[0].translate(pii._LOWER)
                    near.setdefault(i, set()).add(((k, v), t, a, b))
                    seen_p.add(((k, v), t))
        for x in seen_e:
            owners[x] = owners.get(x, 0) + 1
        for x in seen_p:
            both[x] = both.get(x, 0) + 1
    told = {(e, t) for (e, t), c in both.items() if c >= support and owners[e] < n and math.log2(n * c / (owners[e] * having[t])) >= alpha * math.log2(n / owners[e]) - 1e-12}
    return [sorted({(a, b) for e, t, a, b in near.get(i, ()) if (e, t) in told}) for i in range(n)]


def expected(rows):
    out = []
    for (doc_id, text), terms in zip(rows, brute_terms(rows)):
        base = [f"{k}:{s}:{e}" for k, s, e in brute(text)]
        n = [sum(x.startswith(k) for x in base) for k in pii.KINDS]
        out.append((doc_id, *n, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(base + [f"term:{a}:{b}" for a, b in terms])))
    return sorted(out, key=repr)


def query_rows(df):
    found = pii.find(df)
    return sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, hashlib.sha256(",".join(r.base).encode()).hexdigest(), ",".join(r.base + [f"term:{t.s}:{t.f}" for t in r.terms])) for r in found.collect()), key=repr)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "Captain Zorvax uses zor@x.com daily the"), (4, "the zorvax, zor@x.com"), (4, "the zorvax, zor@x.com"), (None, "the other"), (5, "x" * 100000 + " the zor@x.com"), (6, "9.9.9.9 Zorvax zzz the")]
    rows += [(i, "the plain text") for i in range(10, 60)] + [(7, "Zorvax\nother@x.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'q' AS base", "2 AS t")
    got = query_rows(df)
    assert got == expected(rows) and any("term:" in r[-1] for r in got)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "zor@x.com" not in clean[3] and "<EMAIL>" in clean[3] and "Zorvax" not in clean[3] and clean[1] is None and clean[10] == "the plain text"
    assert pii.find(df.limit(0)).collect() == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, pii.op9_pii(spark, SF).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()), key=repr)
    assert got == expected(rows)
    print(sum("term:" in r[-1] for r in got), sum(":" in r[-1] for r in got))
