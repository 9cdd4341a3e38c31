"""Letters, repeated rows in the mix, licence texts of a megabyte."""
import time

from pyspark.sql import functions as F

from riskgraph.llm import langid, licenses, mixing


def test_numbers_are_no_letters(spark):
    rows = [(i, "the cat sat on the mat and the dog ran to the house " * 3, "en") for i in range(1, 9)]
    rows += [(i, "le chat est sur la table et le chien va dans la maison " * 3, "fr") for i in range(9, 17)]
    rows += [(100, "½ ² ① ⅻ 12", "en"), (101, "½ é", "fr")]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == "und" and got[101] != "und" and got[1] == "en" and got[9] == "fr"


def test_equal_rows_are_taken_one_by_one(spark):
    """Five equal rows of 10 words beside another source: target 76.5, of which 80 can be reached and 100 must not."""
    rows = [(1, "w " * 10, "a")] * 5 + [(2, "v " * 1, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in mixing.mix(docs).collect() if r.doc_id == 1]
    target = got[0].target
    assert len(got) == 5 and sorted({r.taken for r in got}) == [10, 20]
    assert abs(sum(r.taken for r in got) - target) <= 5 and all(r.taken <= 2 * r["size"] for r in got)
    copies = mixing.mix_copies(docs).where("doc_id = 1").agg(F.count("*")).first()[0]
    assert copies * 10 == sum(r.taken for r in got)


def test_a_source_is_filled_until_nothing_fits(spark):
    """Sizes that vary widely: what is left is less than the smallest document that could still be taken, or nearer than any."""
    rows = [(i, "w " * (1 + i * i % 397), "a") for i in range(1, 300)] + [(1000, "v " * 9000, "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    a = [r for r in got if r.doc_id < 1000]
    assert abs(sum(r.taken for r in a) - a[0].target) <= 1


def test_licence_texts_of_a_megabyte():
    find, tags = licenses.automaton(), licenses.tag_automaton()
    t = time.time()
    n = 1_000_000 // 12
    got = licenses.scan("mit license " * n, find, tags)
    assert got[1] == n and got[2:4] == (0, 2 * n - 2)
    assert licenses.tag_labels("(" * 200_000 + "mit") == set()
    assert licenses.tag_labels(" or ".join(["mit"] * 50_000) + " and") == {"mit"}
    assert licenses.tag_labels("mit and (isc or bsd-3-clause) with x ) or gpl-2.0") >= {"mit"}
    assert time.time() - t < 4


def test_labels_equal_the_alternatives():
    for text in ("mit", "mit or isc and mpl-2.0", "(mit or isc) and (mpl-2.0 or gpl-2.0 with classpath)", "( mit )", "apache-2.0 with llvm or mit"):
        p = licenses.to_postfix([m[0] for m in licenses.TOKEN.finditer(text)])
        assert licenses.labels_of(p) == set().union(*licenses.evaluate(p))
