import re

from pyspark.sql import functions as F

from seqgraph.llm.op2_pseudonyms import permuted, pseudonymised

TEXTS = [
    (1, "mail ab.c1@x.example.com, and ab.c1@x.example.com; Z@b.org"), (2, "card 4539 1488 0343 6467 ok 4539148803436467 no 4539148803436468"),
    (3, "ip 10.0.255.7 but 1.2.3.456 or 1.2.3.4.5"), (4, "on 2024-02-29 or 29/02/2024, not 2023-02-30"), (5, "call +1 (743) 555-3824 or +49 30 1234567."),
    (6, "ssn 123-45-6789 and 000-12-3456"), (7, None), (8, ""), (9, "clean text"), (9, "clean text"), (10, "4539148803436467"), (11, "a" * 100_000 + " 9" * 30_000),
]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_formats_links_and_edges(spark):
    df = spark.createDataFrame([(*t, 1, "k") for t in TEXTS], "doc_id long, text string, n_card int, kind string")
    rows = pseudonymised(df, "key").collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS)
    for d in (7, 8, 9, 11):
        assert got[d].text == dict(TEXTS)[d]
    a = re.findall(r"[\w.]+@[\w.]+\w", got[1].text)
    assert a[0] == a[1] != "ab.c1@x.example.com" and re.fullmatch(r"[a-z0-9]{2}\.[a-z0-9]{2}@x\.example\.com", a[0]) and got[1].n_email == 3
    c = re.match(r"card (\d{4} \d{4} \d{4} \d{4}) ok (\d{16}) no 4539148803436468$", got[2].text)
    assert c[1].replace(" ", "") == c[2] == got[10].text != "4539148803436467" and luhn(c[2]) % 10 == 0 and got[2].n_card == 2
    ip = re.match(r"ip (\d+)\.(\d+)\.(\d+)\.(\d+) but 1\.2\.3\.456 or 1\.2\.3\.4\.5$", got[3].text)
    assert all(int(x) < 256 for x in ip.groups()) and "10.0.255.7" not in got[3].text
    import datetime

    m = re.match(r"on (\S+) or (\S+), not 2023-02-30$", got[4].text)
    assert datetime.date.fromisoformat(m[1]) == datetime.datetime.strptime(m[2], "%d/%m/%Y").date() != datetime.date(2024, 2, 29)
    assert re.match(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \+49 \d{2} \d{7}\.$", got[5].text) and "555-3824" not in got[5].text
    assert re.match(r"ssn \d{3}-\d{2}-\d{4} and 000-12-3456$", got[6].text)
    assert pseudonymised(df.limit(0), "key").count() == 0


def test_is_a_permutation(spark):
    df = spark.range(1000).select(F.transform(F.split(F.lpad(F.col("id").cast("string"), 3, "0"), ""), lambda x: x.cast("int")).alias("a"))
    out = df.select(permuted(F.col("a"), 10, "k", "t").alias("b")).distinct()
    assert out.count() == 1000
    days = spark.range(0, 146097, 7).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    swapped = pseudonymised(days.withColumn("doc_id", F.lit(1)), "k")
    assert swapped.select("text").distinct().count() == days.count() and swapped.where("n_date = 1").count() == days.count()


def test_national_phones_both_day_orders_and_cards_beside_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 123", f"order 7 {card}", "4111111111111111 12", "call (555) 123-4567", "call 555-123-4567 now", "on 12/31/2024", "x" * 80 + "@b.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonymised(df, "key").collect()}
    assert all(got[d].text != t for d, t in enumerate(texts))
    assert [got[d].n_card for d in range(3)] == [1, 1, 1] and [got[3].n_phone, got[4].n_phone, got[5].n_date, got[6].n_email] == [1, 1, 1, 1]
    beside = re.match(r"(.*) 123$", got[0].text)[1], re.match(r"order 7 (.*)$", got[1].text)[1], re.match(r"(\d{16}) 12$", got[2].text)[1]
    assert len({re.sub(" ", "", x) for x in beside}) == 1 and luhn(beside[0]) % 10 == 0
    assert re.match(r"call \(\d{3}\) \d{3}-\d{4}$", got[3].text) and re.match(r"call \d{3}-\d{3}-\d{4} now$", got[4].text)
    assert re.match(r"on (0\d|1[0-2])/\d\d/\d{4}$", got[5].text)
