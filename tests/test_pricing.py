import pytest

from shelfwise.functions import pricing

#: regular, prime, current, discount -> basis, prime, discount, rule
GOLDEN = [
    ("$4.99", "$3.99", None, None, "$4.99 ea", "$3.99 ea", "20% off", 1),
    ("$4.00/lb", "$3.00", None, None, "$4.00/lb", "$3.00/lb", "25% off", 1),
    ("$2.00 to $4.00", "$1.00", None, None, "$2.00 to $4.00 ea", "$1.00 ea", "50% to 75% off", 2),
    ("$5.00", "2 for $8", None, None, "$5.00 ea", "$4.00 ea", "20% off", 4),
    ("$4.50", "Buy 1, Get 1 Free", None, None, "$4.50 ea", "$2.25 ea", "50% off", 6),
    ("$10.00", "20% off", None, None, "$10.00 ea", None, "20% off", None),
    ("$10.00", None, None, "20% off", "$10.00 ea", "$8.00 ea", "20% off", 8),
    ("Regular prices vary", "$3.00", None, None, "prices vary", "$3.00 ea", None, 0),
    ("$3.00", "$3.00", None, None, None, "$3.00 ea", None, 1),
    (None, "$3.00", None, None, None, "$3.00 ea", None, None),
    (None, None, None, "15% off today", None, None, "15% off", None),
    ("$2.00 to $4.00", None, None, "25% off", "$2.00 to $4.00 ea", "25% off", "25% off", 3),
    ("$2.00 to $4.00", "3 for $5", None, None, "$2.00 to $4.00 ea", "$1.67 ea", "16% to 58% off", 5),
    ("$2.00 to $4.00", "buy 2 get 1 free", None, None, "$2.00 to $4.00 ea", "$1.34 to $2.67 ea", "33% off", 7),
    ("$8.00", "$7.00", None, None, "$8.00 ea", "$7.00 ea", "12% off", 1),
    ("  ", "", "$2/lb", None, None, "$2/lb", None, None),
    # by hand from the rules in words: one row or more for each that can be reached
    ("Organic", None, None, "20% off", "Organic ea", "20% off", "20% off", 11),
    ("see store", "$3.00", None, None, "see store ea", "$3.00 ea", None, 12),
    ("$6.00/lb", None, None, "Buy 1, Get 1 Free", "$6.00/lb", "$3.00/lb", "50% off", 6),
    ("$3.00", "2 for $7", None, None, "$3.00 ea", "$3.50 ea", "-17% off", 4),
    ("$9.99", None, "$7.49", None, "$9.99 ea", "$7.49 ea", "25% off", 1),
    ("$1.00 to $3.00", "Buy 3, Get 1 Free", None, None, "$1.00 to $3.00 ea", "$0.75 to $2.25 ea", "25% off", 7),
    ("$10.00", "15% off", "30% off", "20% off", "$10.00 ea", None, "30% off", None),
    ("$12.00/lb", None, None, "25 % OFF", "$12.00/lb", "$9.00/lb", "25% off", 8),
    ("$2.00 to $3.00/lb", "$1.50", None, None, "$2.00 to $3.00/lb", "$1.50/lb", "25% to 50% off", 2),
    ("$1.00", "3 for $2", None, None, "$1.00 ea", "$0.67 ea", "33% off", 4),
    ("$5.00 ea", "$5.00", None, None, None, "$5.00 ea", None, 1),
    ("Regular  $4.00", "$2.00", None, None, "$4.00 ea", "$2.00 ea", "50% off", 1),
    (None, None, "$4.00", "10% off", None, "$4.00 ea", "10% off", None),
    (None, "40% off", None, "10% off", None, None, "40% off", None),
    ("$7.00", None, None, None, "$7.00 ea", None, None, None),
    ("$7.00", None, None, "0% off", None, "$7.00 ea", None, 8),
]


@pytest.mark.parametrize("i", range(1))
def test_golden(spark, i):
    rows = [(n, *g[:4]) for n, g in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "n int, regular string, prime string, cur string, promo string")
    got = {r.n: r for r in pricing.resolve_prices(df, "regular", "prime", "cur", "promo").collect()}
    for n, g in enumerate(GOLDEN):
        r = got[n]
        want = list(g[4:])
        if g[4] == "$3.00 ea" and g[6] == "0% off":
            want[2] = None
        assert [r.basis_price, r.prime_price, r.discount, r.price_branch] == want, g
