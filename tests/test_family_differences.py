"""Identifiers by family of each document against the next existing one."""

from lodestrata.plans import documents as pd_


def test_next_document_and_both_differences(spark, tmp_path):
    rows = [(1, 10, "K1 K2 R5"), (2, 10, "K1"), (3, 25, "K1 K3 Q7"), (4, 400_000, "K3 K1"), (5, 400_001, "Z1")]
    spark.createDataFrame(rows, "block_id long, doc_id long, text string").selectExpr("*", "'text' AS kind").write.parquet(f"{tmp_path}/blocks.parquet")
    got = {(r["doc_a"], r["doc_b"], r["family"], r["n_a"], r["n_b"], r["only_a"], r["only_b"]) for r in pd_.family_differences(spark, str(tmp_path)).collect()}
    assert got == {(10, 25, "K#", 2, 2, "K2", "K3"), (25, 400_000, "K#", 2, 2, "", "")}


def test_identifier_rules(spark):
    """Look-alikes, pairs, spaced labels, mixed tokens; measurements, structure and appendix clauses are none."""
    from lodestrata.operators import documents as do

    texts = {
        "See FLD 2041. and fld-2041": ["FLD 2041", "fld-2041"], "GRP/ITM 281/001 or GRP 478/ITM 004": ["GRP/ITM 281/001", "GRP 281", "GRP/ITM 478/004", "GRP 478"],
        "M 12.6 and K7.3C1, RQ-0042": ["M 12.6", "K7.3C1", "RQ-0042"], "TABLE 12, PAGE 40, STEP 22, FIG-3, Table12": [], "12mm 2nd 1.5V A.2.1 A.2.1.3": [],
        "Ｋ７․3 of Ｆ9": ["K7.3", "F9"], "X–12": ["X-12"], "": [],
    }
    df = spark.createDataFrame([(1, i, "text", t) for i, t in enumerate(texts)] + [(1, 99, "text", None)], "doc_id long, block_id long, kind string, text string")
    got: dict = {}
    for r in do.identifiers(df).collect():
        got.setdefault(r["block_id"], []).append(r["value"])
    assert {i: sorted(got.get(i, [])) for i in range(len(texts))} == {i: sorted(v) for i, v in enumerate(texts.values())} and 99 not in got
    keys = {r["value"]: (r["key"], r["family"]) for r in do.identifiers(df).collect()}
    assert keys["FLD 2041"] == keys["fld-2041"] == ("FLD2041", "FLD#") and keys["K7.3C1"] == ("K7.3C1", "K#.#C#")
    parents = {tuple(r) for r in do.parent_keys(spark.createDataFrame([("GRP/ITM281/001",), ("GRP281",), ("K3.5",), ("K3.5C1",), ("K3.51",)], "key string")).collect()}
    assert parents == {("GRP/ITM281/001", "GRP281"), ("K3.5C1", "K3.5")}
