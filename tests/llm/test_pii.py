"""Pseudonyms: format, validity, linkage, one-to-one, and the way back."""

import re

from pyspark.sql import functions as F

from cargoscope.llm import pii

TEXTS = ["mail bosbt.42@mail8.example.com. and +1 (988) 555-2485, x", "card 4944339490429605 and 4944 3394 9042 9605 bad 4944339490429606",
         "ip 70.123.182.155. and 999.1.1.1 v 1.2.3", "born 1984-02-29 or 29.02.1984 or 31.02.1984, ssn 667-45-6789 000-12-3456", None, "",
         "a\x01b\x02c +4915112345678 end", "again 1984-02-29, 4944339490429605", "word " * 20000 + "70.123.182.155"]


def run(spark, key="k", back=False, texts=TEXTS):
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_values int").selectExpr("*", "1 AS n")
    return {r.doc_id: r for r in pii.pseudonymise(df, key, back).collect()}


def luhn(s):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(s[::-1])) % 10 == 0


def test_formats_and_links(spark):
    got = run(spark)
    assert [got[i].n_values for i in range(9)] == [2, 2, 1, 3, 0, 0, 1, 2, 1]
    assert re.fullmatch(r"mail user\.[0-9a-f]{16}@mail8\.example\.com\. and \+1 \(\d{3}\) \d{3}-\d{4}, x", got[0].text) and "bosbt" not in got[0].text and "2485" not in got[0].text
    cards = re.fullmatch(r"card (\d{16}) and (\d{4} \d{4} \d{4} \d{4}) bad 4944339490429606", got[1].text)
    assert luhn(cards[1]) and cards[2].replace(" ", "") == cards[1] != "4944339490429605"
    ip = re.fullmatch(r"ip ([\d.]+)\. and 999\.1\.1\.1 v 1\.2\.3", got[2].text)[1]
    assert all(int(x) < 256 for x in ip.split(".")) and got[8].text == "word " * 20000 + ip
    dates = re.fullmatch(r"born (\d{4})-(\d\d)-(\d\d) or (\d\d)\.(\d\d)\.(\d{4}) or 31\.02\.1984, ssn (\d{3}-\d\d-\d{4}) 000-12-3456", got[3].text).groups()
    assert dates[:3] == dates[5:2:-1] and 1900 <= int(dates[0]) <= 2099
    assert got[4].text is None and got[5].text == "" and got[6].text.startswith("a\x01b\x02c +4")
    assert got[7].text == f"again {'-'.join(dates[:3])}, {cards[1]}"
    assert run(spark, "other")[1].text != got[1].text


def test_the_way_back(spark):
    made = run(spark)
    back = run(spark, back=True, texts=[made[i].text for i in range(9)])
    assert all(back[i].text == TEXTS[i] for i in range(1, 9))


def test_one_to_one(spark):
    day = F.expr("cast(date_add(date'1900-01-01', cast(id as int)) as string)")
    out = spark.range(73049).select(day.alias("d")).select("d", pii.pseudonym(F.col("d"), "k").alias("p"))
    assert out.agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()[:] == (73049, "1900-01-01", "2099-12-31")
    three = spark.range(1000).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("p"))
    assert three.agg(F.count_distinct("p"), F.max(F.length("p"))).first()[:] == (1000, 3)


def test_empty_table(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k").columns == ["doc_id", "text", "n_values"]
