"""License notices that are wrapped over lines, against every run of lines looked at one by one."""

from __future__ import annotations

import re
import textwrap
import time

import duckdb
import numpy as np
import pytest

from evirank.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute(text, templates=licenses.TEMPLATES, threshold=0.8):
    """Labels and best containment over all runs of lines with words."""
    lines = [w for w in map(words, (text or "").split("\n")) if w]
    span, labels, best = licenses.span_of(templates), set(), 0.0
    for i in range(len(lines)):
        for j in range(i + 1, min(i + licenses.RUN, len(lines)) + 1):
            if j > i + 1 and sum(map(len, lines[i:j])) > span:
                break
            block = {w for line in lines[i:j] for w in line}
            for label, template in templates:
                t = set(words(template))
                if t and len(t & block) / len(t) >= threshold:
                    labels.add(label)
                    best = max(best, len(t & block) / len(t))
    return labels, best


def results(spark, texts, templates=licenses.TEMPLATES):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: (set(r.labels) - set(r.base_labels), r.score, set(r.base_labels)) for r in licenses.license_scan(docs, templates=templates).collect()}


@pytest.mark.parametrize("width", [30, 50, 72])
def test_wrapped_notices_are_found(spark, width):
    texts = []
    for _, template in licenses.TEMPLATES:
        for prefix in ("", "# ", " * ", "// "):
            wrapped = "\n".join(prefix + line for line in textwrap.wrap(template, width))
            texts.append(f"/*\n{prefix}Copyright someone\n\n{wrapped}\n */\nint main\n")
    got = results(spark, texts)
    for i, (label, _) in enumerate(t for t in licenses.TEMPLATES for _ in range(4)):
        assert label in got[i][0] | got[i][2] and got[i][1] == 1.0, texts[i]


def test_blocks_equal_every_run_of_lines(spark):
    rng = np.random.default_rng(3)
    pool = [w for _, t in licenses.TEMPLATES for w in words(t)] + ["other"] * 20 + ["", "", "-"]
    texts = ["\n".join(" ".join(rng.choice(pool, int(rng.integers(0, 30)))) for _ in range(int(rng.integers(0, 30)))) for _ in range(80)]
    texts += [t.replace(" ", "\n") for _, t in licenses.TEMPLATES] + [None, "", "\n\n", " \n-\n", "permission\n" * 50]
    got = results(spark, texts)
    for i, t in enumerate(texts):
        labels, best = brute(t)
        assert got[i][0] | got[i][2] == labels | got[i][2] and got[i][1] == pytest.approx(best), t
    few = [("x", "alpha beta gamma"), ("y", "delta")]
    texts = ["alpha\nbeta\n\ngamma", "alpha one two\nbeta gamma", "delta " * 9, "alpha\nx y z\nbeta\ngamma"]
    got = results(spark, texts, few)
    assert [(got[i][0], got[i][1]) for i in range(4)] == [brute(t, few) for t in texts]


def test_many_lines_take_time_in_proportion(spark):
    """A text of very many short lines: blocks look a few lines ahead."""
    seconds = []
    for n in (2_000, 40_000):
        docs = spark.createDataFrame([(1, "the software is free of charge\n" * n)], "doc_id long, text string")
        start = time.time()
        assert licenses.license_scan(docs).first().n_words == 6 * n
        seconds.append(time.time() - start)
    assert seconds[1] < 20 * max(seconds[0], 1)


def test_op8_equals_the_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    theirs = con.sql(queries.ORACLES["op8_license_scan"])
    ours = queries.op8_license_scan(spark, "/root/testdata/sf0.001").select(*theirs.columns)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in ours.collect()), key=key) == sorted(theirs.fetchall(), key=key)
    plan = queries.op8_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)
