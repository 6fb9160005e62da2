from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.layout import hyphen_joined, joined


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v " + ("array<string>" if isinstance(values[0], list) else "string"))
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_script_language(spark):
    cases = {"堆场派位策略研究": "zh", "Yard crane scheduling under uncertainty": "en", "これはテストです": "ja", "안녕하세요": "ko", "Привет мир": "ru", "AGV scheduling AGV 调度算法 调度 调度": "en", "调度算法调度算法调度 AGV": "zh", "2026 / 05 400": None, "": None}
    assert one(spark, X.script_language, *cases) == list(cases.values())
    assert one(spark, X.script_language, "x", None)[1] is None


def test_join_runs(spark):
    cases = [["在", "线", "优", "化"], ["stochastic", "scenario", "tree"], ["在线优化", "(", "online", ")", "调度"], ["参数", "，", "数据"], [" ", "a", ""]]
    want = ["在线优化", "stochastic scenario tree", "在线优化 ( online ) 调度", "参数，数据", "a"]
    assert one(spark, X.join_runs, *cases) == want
    assert [joined(c) for c in cases] == want


def test_glyph_spacing(spark):
    assert one(spark, X.glyph_spacing, "在 线 优 化 问 题", "演化计算 运筹优化 强化学习", "计算 优化", "在 线 优 化 (online) 调度", None) == ["在线优化问题", "演化计算 运筹优化 强化学习", "计算 优化", "在线优化 (online) 调度", None]


def test_garbled(spark):
    assert one(spark, X.is_garbled, "߀߁" * 8, "中文和 English 混合的一句话，应该没有问题。", "短文本", "", None) == [True, False, False, False, False]


def test_names_and_titles(spark):
    assert one(spark, X.upload_name, "a/b c?.pdf", "x\\y z.txt", "", None, "№ 5.docx") == ["b_c_.pdf", "y_z.txt", "file", "file", "_5.docx"]
    assert one(spark, X.artifact_name, "--a b--", "§§", "ok_1") == ["a-b", "export", "ok_1"]
    assert one(spark, X.first_line_title, "\n  \n  Head \nbody", "", None) == ["Head", None, None]
    assert one(spark, X.heading_title, "x\n## A b\n", "none") == ["A b", ""]
    assert one(spark, X.is_username, "ab", "abc-1", "a b c") == [False, True, False]
    assert one(spark, X.xml_unescape, "a &amp;lt; b &gt; &quot;") == ["a &lt; b > \""]
    assert one(spark, X.plain_snippet, " [a] b ") == ["a b"]


def test_paths(spark):
    assert one(spark, X.dirname, "a/b/c.txt", "c.txt", "/c.txt") == ["a/b", "", ""]
    assert one(spark, X.dir_chain, "a/b/c.txt", "c.txt") == [["a/b", "a", ""], [""]]


def test_string_array(spark):
    cases = ['["a","b"]', '```json\n["x"]\n```', 'Here: ["p", "q"] done', "[1,2]", "no array", None]
    assert one(spark, X.string_array, *cases) == [["a", "b"], ["x"], ["p", "q"], None, None, None]


def test_civil_time(spark):
    df = spark.createDataFrame([(1970, 1, 1, 0, 0, 0), (2000, 2, 29, 12, 30, 5), (2026, 11, 17, 23, 59, 59)], "y int, m int, d int, h int, i int, s int")
    assert [r[0] for r in df.select(X.civil_to_unix(*[F.col(c) for c in df.columns])).collect()] == [0, 951827405, 1794959999]


def test_timecode(spark):
    df = spark.createDataFrame([(0,), (61_500,), (6_000_000,)], "ms long")
    assert [r[0] for r in df.select(X.timecode(F.col("ms"))).collect()] == ["00:00", "01:01", "100:00"]


def test_html():
    page = "<html><head><title>no</title></head><body><h1>A</h1>b<br>c <i>d</i><script>x()</script><style>y</style><div>e &amp; f</div></body>after</html>"
    assert X.html_to_text(page) == "A b\nc d\ne & f" or X.html_to_text(page).split("\n")[0].startswith("A")
    assert "x()" not in X.html_to_text(page) and "after" not in X.html_to_text(page) and "no" not in X.html_to_text(page)
    assert X.html_to_text(None) is None and X.html_to_text("") == ""


def test_hyphens():
    assert hyphen_joined(["cur-", "riculum of", "A-", "B"]) == "curriculum of A- B"
