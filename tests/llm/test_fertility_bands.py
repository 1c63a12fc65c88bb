import random
import statistics

from tractlens.llm import fertility, queries


def test_every_language_loses_its_junk(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_fertility(spark, sf).filter("NOT base_failed").join(
        queries.read_table(spark, sf, "labels"), "doc_id").join(
        queries.read_table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    for lang in ("de", "en", "es", "fr"):
        share = {q: statistics.mean(r["kept"] for r in got if r["lang"] == lang and r["quality"] == q) for q in (0, 1)}
        assert share[0] < 0.3 and share[1] > 0.995, (lang, share)


def test_every_measure_can_reject_alone(spark):
    rng = random.Random(5)
    plain = "the of and to in is that for it as was with be by on not he his but at".split()
    more = "house water people number sound world place years things under first found great large often along".split()
    say = lambda n: " ".join(rng.choice(plain + more * 2) for _ in range(n))
    rows = [(i, say(rng.choice([80, 150, 300, 600]))) for i in range(300)]
    odd = {1000: say(300) + " 🜁🜂🜃" * 40, 1001: " ".join(rng.choice(plain[:4]) for _ in range(600)),
           1002: say(280) + " 😀", 1003: say(300)}
    docs = spark.createDataFrame([(*r, "en") for r in [*rows, *odd.items()]], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in fertility.quality(docs).collect() if not r["base_failed"]}
    assert not got[1000] and got[1002] and got[1003] and not got.get(1001, False)
    assert sum(got[i] for i in range(300)) >= 297
