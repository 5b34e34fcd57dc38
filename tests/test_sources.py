from datetime import date

import pytest
from pyspark.sql import functions as F

from panelmill.constants import BASE_FEATURES, FULL_FEATURES
from panelmill.sources import files, store


def write(path, text, encoding):
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.fixture
def folder(tmp_path):
    write(tmp_path / "utf.csv", "año,producto,precio\n2020,Maracuyá,\"1,5\"\n", "utf-8")
    write(tmp_path / "bom.csv", "año,producto,precio\n2021,Ñame,2\n", "utf-8-sig")
    write(tmp_path / "latin.csv", "año,producto,precio\n2022,Limón,3\n2022,plain,4\n", "latin-1")
    return tmp_path


def test_csv_charsets(spark, folder):
    got = files.read_csv_with_fallback(spark, str(folder)).collect()
    assert {(r["año"], r.producto, r.precio) for r in got} == {
        ("2020", "Maracuyá", "1,5"), ("2021", "Ñame", "2"), ("2022", "Limón", "3"), ("2022", "plain", "4"),
    }


def test_text_lines(spark, folder):
    lines = files.read_text_with_fallback(spark, str(folder)).collect()
    assert {r.value for r in lines} >= {"año,producto,precio", "2022,Limón,3", "2021,Ñame,2"}


def test_preamble(spark, tmp_path):
    path = write(tmp_path / "ibc.csv", "Banco,,\n,,\nÍndice,,\nAño,Mes,IBC,\n2020,Enero,\"1,25\",\n2020,sept,9,\n2020,Dic,$2,\n", "utf-8-sig")
    got = files.load_sector_index(spark, path, "ibc", "ano,mes,ibc").orderBy("fecha").collect()
    assert [tuple(r) for r in got] == [(None, 9.0), (date(2020, 1, 1), 1.25), (date(2020, 12, 1), 2.0)]
    with pytest.raises(ValueError, match="header"):
        files.read_csv_after_preamble(spark, path, "zzz").collect()
    plain = write(tmp_path / "ipm.csv", "Año,Mes,IPM,Unnamed: 3\n2020,Feb,7,\n", "utf-8")
    assert files.load_sector_index(spark, plain, "ipm").collect() == [(date(2020, 2, 1), 7.0)]


def test_header_detection_and_profile(spark):
    rows = [("a/precios", 0, "title"), ("a/precios", 1, "x,y,z"), ("a/precios", 2, "1,2,3"), ("a/precios", 3, ""), ("a/resumen", 0, "a,b,c"), ("a/resumen", 1, "1,2,3"), ("a/one", 0, "x"), ("a/one", 1, "1")]
    lines = spark.createDataFrame([(f, 0, n, v) for f, n, v in rows], "file string, block int, line int, value string")
    headers = files.header_by_width(lines)
    assert {r.file: r.header for r in headers.collect()} == {"a/precios": "x,y,z", "a/resumen": "a,b,c", "a/one": "x"}
    assert [tuple(r) for r in files.file_profile(lines, headers).collect()] == [("a/precios", 1, 3)]


def test_lines_count_from_0_in_every_file(spark, tmp_path):
    for name, titles in (("a", 2), ("b", 0), ("c", 25)):
        write(tmp_path / f"{name}.csv", "title\n" * titles + "x,y,z\n" + "1,2,3\n" * 50, "utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "64b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = files.file_lines(spark, str(tmp_path))
            numbers = lines.groupBy("file").agg(F.sort_array(F.collect_list("line")).alias("n")).collect()
            headers = files.header_by_width(lines).collect()
            rows = files.file_profile(lines, files.header_by_width(lines)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert len(numbers) == 3 and all(r.n == list(range(len(r.n))) for r in numbers)
        found = {r.file[-5:]: (r.header_line, r.header) for r in headers}
        assert found == {"a.csv": (2, "x,y,z"), "b.csv": (0, "x,y,z"), "c.csv": (0, "title")}
        assert {(r.file[-5:], r.filas, r.columnas) for r in rows} == {("a.csv", 50, 3), ("b.csv", 50, 3)}


def test_catalog_of_tables(spark, folder):
    tables = files.load_tables(spark, {"precios": str(folder / "utf.csv")})
    assert spark.table("precios").columns == tables["precios"].columns == ["año", "producto", "precio"]


RESULT = "product_id string, model_name string, feature_set string, provincia string, y_pred double"


def test_result_store(spark, tmp_path):
    path = str(tmp_path / "predictions")
    rows = [("p", "a", "full", "x", 1.0), ("p", "b", "full", "x", 2.0), ("q", "a", "base", "y", 3.0)]
    store.write_results(spark.createDataFrame(rows, RESULT), path)
    store.write_results(spark.createDataFrame([("p", "a", "full", "z", 9.0)], RESULT), path)
    got = {(r.product_id, r.model_name, r.provincia, r.y_pred) for r in store.read_results(spark, path).collect()}
    assert got == {("p", "a", "z", 9.0), ("p", "b", "x", 2.0), ("q", "a", "y", 3.0)}
    pruned = store.read_results(spark, path, product_id="p", feature_set="full")
    assert pruned.count() == 2 and "PartitionFilters: [isnotnull(product_id" in pruned._jdf.queryExecution().toString()


def test_csv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([("á", 1.5, None)], "product_key string, v double, w string")
    store.save_csv(df, str(tmp_path / "c"))
    assert files.read_csv_with_fallback(spark, str(tmp_path / "c")).collect()[0].product_key == "á"
    store.save_json(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).collect()[0].value == '{"product_key":"á","v":1.5,"w":null}'
    document = spark.createDataFrame([("k", "K", (1, 2.0))], "product_key string, product_name string, preprocessing_summary struct<a:int,b:double>")
    store.save_json(document, str(tmp_path / "m"))
    assert store.metadata_rollup(spark, str(tmp_path / "m")).collect()[0].asDict() == {"product_key": "k", "product_name": "K", "a": 1, "b": 2.0}


def test_feature_lists(spark):
    assert store.feature_list(None, "base") == BASE_FEATURES and len(BASE_FEATURES) == 16
    assert len(FULL_FEATURES) == 42 and store.feature_list({"recommended_model_features": ["x"]}, "full") == ["x"]
    with pytest.raises(ValueError):
        store.feature_list(None, "other")
    df = spark.createDataFrame([("2020-01-01", "a", 1, 2.0), ("bad", "a", 1, 2.0)], "fecha string, provincia string, provincia_id int, target_precio_mercado_usdkg double")
    meta = {"base_model_features": ["provincia_id"]}
    with pytest.raises(ValueError, match="missing"):
        store.load_bundle(df, "base", meta)
    assert store.load_bundle(df.where(F.col("fecha") != "bad"), "base", meta).features == ["provincia_id"]
