"""Every operator and stage on nulls, empty and very long texts, ties, equal rows, empty tables and clashing column names."""
import pytest

from riskgraph.llm import decontam, jaccard, langid, licenses, lines, mixing, quality, substring, toxicity, urls

from .rows import edge_rows

SPARE = "toxic int, quality int, doc_id long"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 1), (0, 1, 2), (None, 1, 3), (0, None, 6), (1, 1, None)], SPARE)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "Quick brown fox jumps over the lazy dog and runs", 5), (2, None, 5), (None, "", 5), (3, "x", 5)],
                                 "item_id long, text string, n int")


def operators(labels, bench):
    return {
        "op1": lambda d: decontam.find_leaks(d, bench), "op2": substring.dedup_substrings, "op3": langid.identify,
        "op4": lambda d: toxicity.score_documents(d, labels), "op5": quality.quality_rules, "op7": lines.line_report,
        "op8": lambda d: mixing.mix(d), "op9": licenses.license_scan, "op10": jaccard.jaccard_components,
        "stage4": lambda d: toxicity.drop_toxic(d, labels), "stage7": lines.dedup_lines,
        "stage1": lambda d: decontam.clean_documents(d, bench), "stage8": mixing.mix_copies,
    }


NAMES = ["op1", "op2", "op3", "op4", "op5", "op7", "op8", "op9", "op10", "stage4", "stage7", "stage1", "stage8"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(make_docs, labels, bench, name):
    assert operators(labels, bench)[name](make_docs([])).collect() == []


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op7", "op8", "op9", "op10"])
def test_a_row_for_each_row(make_docs, labels, bench, name):
    rows = edge_rows()
    got = operators(labels, bench)[name](make_docs(rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)


def test_leaks(make_docs, labels, bench):
    got = {(r.doc_id, r.item_id): r for r in operators(labels, bench)["op1"](make_docs(edge_rows())).collect()}
    assert {k for k in got if k[1] == 1} == {(1, 1), (2, 1), (None, 1), (10, 1)}
    assert {k for k in got if k[1] == 3} == {(8, 3)} and got[(8, 3)].similarity == 1.0    # an item of one word
    assert got[(1, 1)].start == 1 and got[(1, 1)].n_words == 10


def test_stages_keep_columns(make_docs, labels, bench):
    docs, ops = make_docs(edge_rows()), operators(labels, bench)
    for name in ("stage4", "stage7", "stage1"):
        assert ops[name](docs).columns == docs.columns
    assert ops["stage8"](docs).columns == docs.columns + ["copy_no"]
    assert ops["stage4"](docs).count() == len(edge_rows())                    # nothing toxic
    kept = ops["stage1"](docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "4", "5", "6", "7", "9", "None"]


def test_lines_and_substrings(make_docs, labels, bench):
    docs, ops = make_docs(edge_rows()), operators(labels, bench)
    texts = {(r.doc_id, r.text) for r in ops["stage7"](docs).collect()}
    assert (6, "") not in texts and (7, "") in texts and (2, "") in texts and (3, None) in texts and (5, " \t\n ") in texts
    removed = {r.doc_id: r for r in ops["op2"](docs).collect()}
    assert removed[6].n_removed == 0 and removed[7].n_removed == removed[7].n_words == 30_000
    assert removed[3].n_words == 0 and removed[2].n_removed == 0             # fewer than 50 words


def test_components_and_languages(make_docs, labels, bench):
    docs, ops = make_docs(edge_rows()), operators(labels, bench)
    comp = {r.doc_id: r for r in ops["op10"](docs).collect()}
    assert comp[2].component_id == 1 and comp[7].component_id == 6 and comp[10].component_id == 1
    assert comp[3].component_id == 3 and comp[3].n_shingles == 0 and comp[8].n_shingles == 1 and comp[None].component_id is None
    pred = {r.doc_id: r.lang_pred for r in ops["op3"](docs).collect()}
    assert pred[3] == pred[4] == pred[5] == pred[9] == "und" and pred[2] == "en"


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/x"), (4, "http://A.Example.ORG/es/1?q"), (5, "https://x.com/fr/"), (6, "https://x.com/fr"),
            (7, "http://example.org/en/12#t"), (8, "http://example.org/en/2"), (None, "http://y.com/de/1"), (9, "http://net/" + "a" * 50_000), (9, "http://net/" + "a" * 50_000)]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[1].host == by[3].host == by[3].path == ""
    assert (by[4].host, by[4].path, by[4].rule, by[4].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert by[5].rule == "com/fr/" and by[6].rule is None and by[7].rule == "example.org/en/1" and by[8].rule == "org/"
    assert by[None].verdict == "block" and all(r.verdict in ("allow", "block") for r in got)
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, host int")).collect() == []
