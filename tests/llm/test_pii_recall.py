"""How many planted names the method adds: terms that stand with one person's addresses, in unlike documents."""

import random

from shelfwise.llm import pii


def planted(seed, people=60, others=900):
    """Documents of people, each in two to four; a name stands anywhere, now and then in a document of another person too."""
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("re", "tan", "mo", "li", "sha", "ker") for b in ("ti", "na", "lo", "dra", "ves")]
    plain = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows, names = [], {}
    for p in range(people):
        name, mail = f"Zq{p:03d}vax", f"user{p}@mail{p % 7}.org"
        for _ in range(r.randint(2, 4)):
            entity = mail if r.random() < 0.8 else f"10.{p}.3.{r.randint(1, 9)} and {mail}"
            parts = [plain(r.randint(5, 60)), name if r.random() < 0.5 else name.upper(), plain(r.randint(0, 40)), entity, plain(r.randint(1, 30))]
            if r.random() < 0.5:
                parts.reverse()
            names[len(rows)] = name.lower()
            rows.append((len(rows), "\n".join(parts)))
    rows += [(len(rows) + i, plain(r.randint(5, 80))) for i in range(others)]
    return rows, names, {w for w in words}


def test_recall(spark):
    rows, names, words = planted(4)
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    told = {i: {texts[i][t.s : t.f].lower() for t in r.terms} for i, r in found.items()}
    caught = sum(name in told[i] for i, name in names.items())
    assert caught >= 0.9 * len(names)
    assert all(texts[i][int(x.split(":")[1]) : int(x.split(":")[2])] for i, r in found.items() for x in r.base)
    wrong = sum(bool(told[i] & words) for i in names)
    assert wrong <= 0.02 * len(names)
    assert not any(told[i] for i in told if i not in names)
    clean = {r.doc_id: r.text.lower() for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(name not in clean[i] for i, name in names.items()) >= 0.9 * len(names)
