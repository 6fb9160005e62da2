from pyspark.sql import functions as F

from tessera.functions import records as R


def test_secrets_and_settings(spark):
    df = spark.createDataFrame([("x", "old", '{"a": 1}'), ("", "old", "broken"), ("__set__", "old", None), (None, "old", "{}")], "w string, s string, j string")
    got = df.select(R.masked(F.col("w")), R.unmasked(F.col("w"), F.col("s")), R.setting(F.col("j"), "struct<a:int>", F.struct(F.lit(7).alias("a")))["a"]).collect()
    assert [r[0] for r in got] == ["__set__", "", "__set__", ""] and [r[1] for r in got] == ["x", "", "old", None] and got[0][2] == 1 and got[2][2] == 7


def test_codes_and_signature(spark):
    df = spark.createDataFrame([("ja",), ("ko",), ("fr",), ("es",), ("en",)], "l string")
    assert [r[0] for r in df.select(R.backend_code(F.col("l"), "baidu")).collect()] == ["jp", "kor", "fra", "spa", "en"]
    assert df.select(R.backend_code(F.col("l"), "deepl")).first()[0] == "JA"
    assert spark.range(1).select(R.signature(F.lit("a"), F.lit("b"))).first()[0] == "187ef4436122d1cc2f40dc2b92f0eba0"


def test_refs(spark):
    df = spark.createDataFrame([('[{"assetId":"a","ordinal":2},{"assetId":"b"},{"ordinal":1},{"assetId":"c","ordinal":0}]',), ("nothing",), (None,)], "j string")
    assert [[(x["assetId"], x["ordinal"]) for x in r[0]] for r in df.select(R.typed_refs(F.col("j"))).collect()] == [[("a", 2)], [], []]


def test_tool_answers(spark):
    assert R.collected_text('{"result": {"ocrResults": [{"prunedResult": {"rec_texts": [" a", "b ", 3, " "]}}, {}]}, "modelName": "m"}') == "a b"
    assert R.collected_text('{"y": ["w"], "x": {"text": "hello", "modelName": "skip", "u": "http://x", "box": ["no"]}}') == "hello w"
    assert R.collected_text("no json") is None and R.collected_text(None) is None
    f = spark.range(1).select(R.media_facts(F.lit('{"format":{"duration":"1.5","tags":{"t":"v"}},"streams":[{"codec_type":"video","codec_name":"h264","width":2,"height":1}]}')).alias("m")).first()["m"]
    assert f["format"]["duration"] == "1.5" and f["streams"][0]["width"] == 2


def test_hashed_vectors():
    v = R.hashed_vector("The quay crane")
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-5 and v == R.hashed_vector("the QUAY crane") and R.hashed_vector(" ") is None and R.hashed_vector(None) is None
