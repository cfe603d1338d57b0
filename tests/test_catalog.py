"""Every registered core query against its SQL, and the rest for rows and stable columns."""

import pytest

from corpusmill.plans import catalog


def test_every_sql_has_its_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(name, check_sql):
    check_sql(catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(name, spark, sf_dir):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and len(rows) == len(set(rows)) and all(any(x is not None for x in r) for r in rows)


def test_pipeline_describes_the_chosen_fetches(spark, sf_dir):
    made = catalog.QUERIES["corpus_pipeline"](spark, sf_dir).collect()
    chosen = {(r.page_id, r.domain, r.slug, r.url, r.crawled_at, r.tags) for r in catalog.QUERIES["corpus_documents"](spark, sf_dir).collect()}
    assert {(r.page_id, r.domain, r.slug, r.url, r.crawled_at, r.tags) for r in made} == chosen
    grade = lambda s: "excellent" if s >= 90 else "good" if s >= 75 else "fair" if s >= 50 else "poor"
    assert all(r.completeness_grade == grade(r.completeness_score) and r.title and len(r.description) <= 320 and (r.section_count == 0 or r.word_count >= 5) for r in made)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_core_does_without_the_training_subpackage(monkeypatch):
    import builtins
    import sys

    import __spark_entry__

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if "llm" in name.split("."):
            raise ModuleNotFoundError("gone", name="corpusmill.llm")
        return real(name, *args, **kwargs)

    for m in [m for m in sys.modules if m.startswith("corpusmill.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", without)
    assert "corpus_pipeline" in __spark_entry__.queries()
    assert not any(n.startswith("p1_") for n in __spark_entry__.queries())
