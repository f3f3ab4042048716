from fathom.plans import registry


def test_every_added_column_is_in_the_table(spark, tmp_path):
    rows = [(0, 1, "method,top_k,config_hash,seed"), (0, 2, "bm25,10,ab12,7"), (1, 1, "metod;top_k;some.new name;Config_Hash;Line_No"), (1, 2, "dense;20;x;cd34;5")]
    spark.createDataFrame(rows, "file_id long, line_no int, line string").write.parquet(f"{tmp_path}/evaluation_summary.parquet")
    spark.createDataFrame([(1, "method", "string"), (2, "top_k", "int")], "position int, field string, field_type string").write.parquet(f"{tmp_path}/summary_fields.parquet")
    t = registry.p3_table(spark, str(tmp_path))
    got = {r.file_id: r.asDict() for r in t.collect()}
    assert (got[0]["config_hash_2"], got[0]["seed"], got[1]["some.new name"], got[1]["config_hash_2"]) == ("ab12", 7, "x", None)
    assert dict(t.dtypes)["seed"] == "int" and dict(t.dtypes)["config_hash_2"] == "string"
    assert all("config_hash" not in (r["rescued"] or "") and "some.new name" not in (r["rescued"] or "") for r in got.values())
    assert (got[1]["Config_Hash"], got[0]["config_hash_2"], got[1]["Line_No_2"]) == ("cd34", "ab12", "5")
