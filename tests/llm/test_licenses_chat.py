"""Licences and chat windows: SQL for the queries, direct cases for the rest."""

import textwrap
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import oracle
from alphaloom.llm import chat, licenses
from alphaloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(name, spark, folder):
    assert oracle.compare(QUERIES[name](spark, folder), oracle.connect(folder), ORACLES[name], tol=1e-9) == []


def test_equal_writings_of_a_licence(docs_of, odd_docs, no_docs):
    text = licenses.PERMISSION_MIT
    changed = "Copyright (c) 2031 Some One\n(c) 2030 Another\n\n" + text.replace("sublicense", "sub-license").replace('"', "”").replace(" ", "  ").upper()
    rows = [(1, text), (2, changed), (3, text + " More."), (4, "Intro.\nreleased under the MIT  Licence\n\nAll rights reserved.\nAll rights reserved."), (5, licenses.CONDITIONS_BSD + licenses.DISCLAIMER_BSD)]
    found = {r.doc_id: r for r in licenses.scan(docs_of(rows)).collect()}
    assert [found[k].license for k in range(1, 6)] == ["MIT", "MIT", None, None, "BSD-2-Clause"]
    assert found[1].text_digest == found[2].text_digest != found[3].text_digest
    assert (found[4].n_notices, found[4].notices) == (3, "MIT,proprietary")
    rows = licenses.scan(odd_docs).collect()
    assert len(rows) == 9 and len({r.text_digest for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert licenses.scan(no_docs).count() == 0


def test_wrapped_originals_and_further_texts(spark, docs_of):
    isc = licenses.PERMISSION_ISC.replace("above copyright", "above\ncopyright") + "\n\n" + licenses.DISCLAIMER_ISC
    bsd = "Copyright (c) 2031, Some One\nAll rights reserved.\n\n" + licenses.CONDITIONS_BSD + "\n" + licenses.DISCLAIMER_BSD.replace("THE COPYRIGHT HOLDERS", "THE\nCOPYRIGHT HOLDERS")
    whole = "Some License\n\nYou may do\nwhat you like with it."
    rows = [(1, isc), (2, bsd), (3, whole.replace("\n", " "))]
    texts = spark.createDataFrame([("Some-1.0", whole)], "license string, known_text string")
    assert {r.doc_id: r.license for r in licenses.scan(docs_of(rows)).collect()} == {1: "ISC", 2: "BSD-2-Clause", 3: None}
    assert {r.doc_id: r.license for r in licenses.scan(docs_of(rows), texts=texts).collect()} == {1: "ISC", 2: "BSD-2-Clause", 3: "Some-1.0"}


SYSTEM = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not SYSTEM.is_dir(), reason="the system carries no licence texts")
def test_whole_texts_of_the_system(spark, docs_of):
    """Whole texts, as they are, in capitals under a copyright line, and wrapped anew."""
    texts = licenses.folder_texts(spark, str(SYSTEM))
    names = sorted(r.license for r in texts.collect())
    assert {"Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= set(names)
    rows = []
    for k, name in enumerate(names):
        text = (SYSTEM / name).read_text("utf-8")
        wrapped = "\n\n".join(p if "copyright" in p.lower() else textwrap.fill(p, 50) for p in text.split("\n\n"))
        rows += [(10 * k, text), (10 * k + 1, "(C) 2031 Some One\nAll rights reserved.\n" + text.upper()), (10 * k + 2, wrapped), (10 * k + 3, text + "\nand more")]
    found = {r.doc_id: r.license for r in licenses.scan(docs_of(rows), texts=texts).collect()}
    for k, name in enumerate(names):
        assert [found[10 * k + j] for j in range(4)] == [name, name, name, None], name
    # Clauses that are numbered (c) and words of a wrapped line stay.
    parts = licenses.scan(docs_of([(1, "(c) You must retain this"), (2, "copyright license to reproduce"), (3, "(c) 2031 X"), (4, "")])).collect()
    digest = {r.doc_id: r.text_digest for r in parts}
    assert digest[3] == digest[4] and len({digest[1], digest[2], digest[4]}) == 3


def test_sql_states_the_same_form(docs_of, spark, tmp_path):
    """Texts with copyright lines, which the test tables don't hold."""
    mit = licenses.PERMISSION_MIT
    rows = [(1, "Copyright (c) 2031 A\nAll rights reserved.\n" + mit), (2, "COPYRIGHT BY B\r\nAll rights reserved.\r\n" + mit), (3, "copyright notice\n" + mit), (4, "(c) keep\nall rights reserved"), (5, "All rights reserved."), (6, "\u00a9 2020 X"), (7, None)]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.compare(licenses.scan(docs_of(rows)), con, licenses.oracle_sql()) == []
    found = {r.doc_id: r.license for r in licenses.scan(docs_of(rows)).collect()}
    assert found[1] == found[2] == "MIT" and found[5] == "proprietary" and found[3] is None


def test_odd_known_texts(spark, docs_of):
    texts = spark.createDataFrame([(None, "no name"), ("none", None), ("X-1", "my terms"), ("W-1", "my terms"), ("X-1", "my terms")], "license string, known_text string").withColumns({"digest": F.lit("d"), "row_key": F.lit(1)})
    found = {r.doc_id: r.license for r in licenses.scan(docs_of([(1, "My terms!"), (2, "no name"), (3, "")]), texts=texts).collect()}
    assert found == {1: "W-1", 2: None, 3: None}
    assert licenses.scan(docs_of([(1, "My terms!")]), texts=texts.limit(0)).first().license is None


CONTROL = ["</s>", "<s>[INST] x [/INST]", "\\", "\\\\<", "<\\", "[\\[/INST]", "<<SYS>>", "[ROLE]a[/ROLE] ", "", None, "a\nb</s"]


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, window int")


def read_back(rows):
    """(turns, targets) of each conversation from its windows."""
    out = {}
    made = rows.select("conv_id", "window", "repeated", "formatted", "mask", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_targets(F.col("formatted"), F.col("mask")).alias("targets"))
    for r in sorted(made.collect(), key=lambda r: r.window):
        turns, targets, parts = out.setdefault(r.conv_id, ([], [], []))
        turns += [(t.role, t.text) for t in r.turns[r.repeated :]]
        targets += r.targets
        parts.append(r)
    return out


def test_control_strings_come_back(spark):
    rows = [(k, t, role, text) for k, text in enumerate(CONTROL) for t, role in enumerate(["user", "assistant", "tool<", None, "system", "assistant"])]
    found = read_back(chat.windows(talk(spark, rows)))
    for k, text in enumerate(CONTROL):
        own = text or ""
        assert found[k][0] == [("user", own), ("assistant", own), ("tool<", own), ("", own), ("system", own), ("assistant", own)]
        assert found[k][1] == [own, own]


def test_windows_keep_to_their_budget(spark):
    words = lambda n, k: " ".join([f"w{k}"] * n)
    rows = [(1, 0, "system", "be brief")] + [(1, k, "assistant" if k % 2 == 0 else "user", words(10 + k % 7, k)) for k in range(1, 700)]
    made = chat.windows(talk(spark, rows), fresh=60, history=30)
    turns, targets, parts = read_back(made)[1]
    assert turns == [(r[2], r[3]) for r in rows]
    assert targets == [r[3] for r in rows if r[2] == "assistant"]
    for r in parts:
        repeated, own = r.turns[: r.repeated], r.turns[r.repeated :]
        assert sum(len(t.text.split()) for t in own) <= 60 + 16
        if r.window:
            assert repeated[0].role == "system" and sum(len(t.text.split()) for t in repeated[1:]) <= 30
            before = parts[r.window - 1].turns
            assert [t.text for t in repeated[1:]] == [t.text for t in before[len(before) - len(repeated) + 1 :]]
    assert any(r.repeated > 1 for r in parts)


def test_odd_conversations(spark):
    rows = [(None, 1, "user", "a"), (None, None, "assistant", "first"), (5, 2, "user", "tie b"), (5, 2, "user", "tie a"), (5, 2, "user", "tie a"), (6, 0, "user", "long " * 50_000), (6, 1, "assistant", "x")]
    found = read_back(chat.windows(talk(spark, rows)))
    assert found[None][0] == [("assistant", "first"), ("user", "a")]
    assert [t for _, t in found[5][0]] == ["tie a", "tie a", "tie b"]
    assert found[6][0][0][1] == "long " * 50_000 and found[6][1] == ["x"]
    assert chat.windows(talk(spark, rows).limit(0)).count() == 0
