"""Whole licences without their appendix, under a title, and within longer documents."""

import duckdb
import pytest
from compare import same

from tabloom.llm import licenses, queries


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def cases():
    whole = {}
    for name, text in licenses.KNOWN:
        if len(text) > len(whole.get(name, "")):
            whole[name] = text
    apache, gpl, mpl = whole["Apache-2.0"], whole["GPL-3.0"], whole["MPL-2.0"]
    end = lambda t, mark: t[: t.index(mark)]
    rows = [
        (1, end(gpl, "END OF TERMS")), (2, end(apache, "APPENDIX")), (3, end(apache, "END OF TERMS") + "END OF TERMS AND CONDITIONS\n"), (4, "The license of this project\n\n" + apache), (5, end(mpl, "Exhibit A -")),
        (6, "# A project\n\nSome words on it.\n\n" + end(apache, "END OF TERMS") + "\n\nMore words after it.\n\n" + whole["LGPL-3.0"]), (7, "Title\n\n" + gpl.replace("\n\n", "\n \t\n").upper()),
        (8, "Title\n\n" + apache.replace("perpetual", "temporary")), (9, "\n\n".join(apache.split("\n\n")[:20])), (10, "a\n\nlicense\n\n\n\nb"), (11, None), (12, ""), (None, apache), (4, "again\n\n" + apache), (13, "\n\n\n\n" + apache + "\n\n\n"),
    ]
    return rows


def test_licences_are_found_whole_within_texts(spark, cases):
    got = {(r["doc_id"], r["license"]): r["whole"] for r in licenses.scan(docs(spark, cases)).collect()}
    want = {(1, "GPL-3.0"): True, (2, "Apache-2.0"): True, (3, "Apache-2.0"): True, (4, "Apache-2.0"): False, (5, "MPL-2.0"): True, (6, "Apache-2.0"): False, (6, "LGPL-3.0"): False, (7, "GPL-3.0"): False, (13, "Apache-2.0"): True}
    # headers and notices that stand in the appendix or are quoted by a text count as before
    assert {k: v for k, v in got.items() if k in want} == want
    assert not {k for k in got if k[0] in (8, 9) and k[1] == "Apache-2.0" and got[k]}
    changed = licenses.scan(docs(spark, [(8, dict((r[0], r[1]) for r in cases)[8].split("APPENDIX")[0])]))
    assert changed.count() == 0


def test_runs_in_sql(spark, cases, tmp_path):
    docs(spark, [r for r in cases if r[0] is not None]).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(queries.op7_license_scan(spark, str(tmp_path)), con, licenses.SQL)
