import random
import zlib

from pyspark.sql import functions as F

from canopy.llm import langid
from canopy.llm.common import fold

WORDS = {
    "en": "the and of to in is that for it as was with be by on not he his but at are this have from or had an they which one".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son été mais".split(),
}


def rows(n=240):
    rng = random.Random(7)
    langs = list(WORDS)
    return [(i, " ".join(rng.choice(WORDS[langs[i % 3]]) for _ in range(rng.randint(8, 60))), langs[i % 3], "s") for i in range(n)]


def identify(docs):
    return langid.identify(docs, fold("doc_id") != 0, keep=("doc_id",))


def test_held_out_accuracy(spark, documents):
    docs = documents(rows())
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where(fold("doc_id") == 0).collect()
    assert len(got) > 30
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, documents):
    plain = documents(rows())
    changed = plain.withColumn("lang", F.when(fold("doc_id") == 0, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert sorted(identify(plain).collect()) == sorted(identify(changed).collect())


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(rows() + [(1000 + i if i is not None else None, *rest) for i, *rest in odd_rows])
    got = {r.doc_id: r for r in identify(docs).collect()}
    for i in (1002, 1003, 1004, 1005):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[1006].lang_pred == "en"
    assert identify(docs).count() == 240 + len(odd_rows)
    assert identify(docs.limit(0)).count() == 0


def test_without_training_rows_everything_is_unknown(spark, documents):
    docs = documents([(1, "some words here", None, "a")])
    assert [r.lang_pred for r in identify(docs).collect()] == ["und"]


def test_narrow_margins_are_rejected(spark, documents):
    a, b = [i for i in range(5000, 5100) if zlib.crc32(str(i).encode()) % 5 == 0][:2]
    mixed = [(a, " ".join(" ".join(w) for w in zip(WORDS["en"], WORDS["de"])), "en", "s")]
    clear = [(b, " ".join(WORDS["en"]), "en", "s")]
    docs = documents(rows() + mixed + clear)
    got = {r.doc_id: r for r in langid.identify(docs, fold("doc_id") != 0, margin=0.1).collect()}
    assert got[a].margin < got[b].margin
    assert got[a].rejected and not got[b].rejected


def test_numbers_that_are_no_letters_have_no_language():
    found = langid.Classifier({"en": b"the and of to in is that for", "de": b"der die und in den von zu"})
    for text in ("\u00b2 \u00bd \u2460 \u2167", "12 !? _", "", None):
        assert found.predict(text) == ("und", 0.0, 0.0)
    assert found.predict("\u00b2 the")[0] != "und"
