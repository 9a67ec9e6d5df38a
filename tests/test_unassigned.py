import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilcheck.functions.ucd import hazard_class, unknown
from veilcheck.operators import native
from veilcheck.operators.screen import screen
from veilcheck.plans.oracle import KIND, ORACLE_SQL
from veilcheck.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
WHOLE = ("hazard_kind_counts", "hazard_by_codepoint", "hazard_severity_by_source", "hazard_by_lang_rollup", "hazard_labels_join")


def test_unknown_is_the_hazard_of_the_tables(spark, tables):
    got = np.zeros(0x110000, bool)
    for a, b in unknown(spark):
        got[a : b + 1] = True
    assert (got == (tables.hazard == 4)).all()


def test_every_unassigned_code_point_is_found(spark, tables):
    points = np.flatnonzero(tables.hazard == 4).tolist()
    # one unassigned code point of each 500 and those at edges, each in a text that goes on
    some = sorted({*points[::500], *(p for p in points if not tables.hazard[p - 1] == 4), 0x378, 0xFFFF, 0x10FFFF})
    docs = spark.createDataFrame([(p, f"a{chr(p)}жb") for p in some] + [(-1, "".join(chr(p) + "x" for p in some))], "doc_id long, text string")
    want = sorted((r.doc_id, r.offset, r.codepoints[0], r.kind) for r in screen(docs, kinds=native.KINDS).collect())
    assert len(want) == 2 * len(some)
    assert sorted((r.doc_id, r.offset, r.codepoint, r.kind) for r in native.located(docs).collect()) == want
    found = native.hazards(docs, "doc_id").select("doc_id", "cp", "kind", "severity").collect()
    assert sorted((r.doc_id, f"U+{r.cp:04X}", r.kind) for r in found) == sorted((w[0], w[2], w[3]) for w in want) and {r.severity for r in found} == {"medium"}


def test_assigned_ones_are_not(spark, tables):
    rows = spark.createDataFrame([("".join(chr(c) for c in range(lo, lo + 4096) if not 0xD800 <= c < 0xE000 and tables.hazard[c] != 4),) for lo in range(0, 0x40000, 4096)], "text string")
    assert rows.where(F.col("text").rlike(hazard_class(native.KINDS[3], spans=unknown(spark)))).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
@pytest.mark.parametrize("name", WHOLE)
def test_counts_hold_unassigned_code_points(spark, name):
    """Their SQL has the kinds of the SQL of all_kinds, U+0378 among them."""
    duck = duckdb.connect()
    for f in os.listdir(DATA):
        duck.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    assert KIND.format(unassigned="OR cp = 888") in ORACLE_SQL[name]
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    got = [tuple(map(str, (r[c] for c in names))) for r in QUERIES[name](spark, DATA).collect()]
    assert sorted(got) == sorted(tuple(map(str, r)) for r in result.fetchall())
