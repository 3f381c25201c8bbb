import hashlib

import numpy as np
import public_tokenizers

import __spark_entry__ as entry_module
import corpus_pipeline
from checks.compare import connect, plain, sortable
from reviewgate.llm import bpe, decontaminate, language_id, quality_rules, simhash
from reviewgate.llm.queries import ORACLE, QUERIES
from .test_quality_rules import plain as plain_measures
from .test_simhash import plain_fingerprint, plain_groups


def test_registered():
    names = entry_module.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert set(ORACLE) <= set(entry_module.oracle_sql())
    assert [f"op{n}_" for n in range(1, 14)] == sorted(
        (x.split("_")[0] + "_" for x in QUERIES), key=lambda x: int(x[2:-1])
    )


def test_sql_agrees(spark, sf):
    db = connect(sf)
    for name, sql in ORACLE.items():
        frame = QUERIES[name](spark, sf)
        columns = sorted(frame.columns)
        got = sorted((tuple(plain(r[x]) for x in columns) for r in frame.collect()), key=sortable)
        relation = db.execute(sql)
        order = [d[0] for d in relation.description]
        want = sorted(
            (tuple(plain(r[order.index(x)]) for x in columns) for r in relation.fetchall()),
            key=sortable,
        )
        assert sorted(order) == columns and got == want, name


def test_against_plain_python(spark, sf):
    """The whole run, stage by stage, on the driver."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(table.collect(), key=lambda r: r.doc_id)
    model = language_id.train(table)
    kept = []
    for r in rows:
        lang, score = model.predict(r.text)
        if lang != "und" and score >= 0.5:
            kept.append(r)
    passing = []
    for r in kept:
        words, chars, symbols, lines, again, repeated = plain_measures(r.text)
        if not (
            words < 50 or 100 * repeated > 50 * words or 10 * symbols > words
            or 10 * again > 3 * lines or chars < 2 * words or chars > 25 * words
        ):
            passing.append(r)
    groups = plain_groups([plain_fingerprint(r.text) for r in passing])
    heads = [r for i, r in enumerate(passing) if groups[i] == i]
    known = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items = decontaminate.Items.of(known)
    clean = []
    for r in heads:
        text = items.numbered(r.text)
        if not any(
            decontaminate.align(np.array(t), text)[0] >= decontaminate.LEAST_SCORE
            for t in items.texts
        ):
            clean.append(r)
    own = bpe.tokenizer(public_tokenizers.path(corpus_pipeline.VOCABULARY), public_tokenizers.PATTERN)
    want = {
        (r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        for r in clean
        for ids in [own.encode(r.text)]
    }
    got = corpus_pipeline.run(spark, sf).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in got} == want
    assert len(got) == len(want)


def test_stages_keep_columns_and_take_odd_rows(spark, sf, docs, prose):
    long = " ".join(f"the word{i} of" for i in range(20_000))
    frame = docs(
        [(1, prose[0]), (1, prose[0]), (None, prose[1]), (2, None), (3, ""), (4, long)],
        clashing=True,
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, frame, sf)
        assert after.columns == frame.columns, name
        assert after.count() <= frame.count()
        assert stage(spark, frame.limit(0), sf).count() == 0, name
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, frame, sf).count() == frame.count()
    assert simhash.keep_one(frame).filter("doc_id = 1").count() == 1
    assert quality_rules.keep_passing(frame).filter("doc_id = 4").count() == 1
