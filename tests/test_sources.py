import gzip
import json
import zipfile

from pyspark.sql import functions as F

from tarkib.operators import engines, layout, sequences
from tarkib.sources import readers, writers
from tarkib.streaming import updates


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_separated_files(spark, tmp_path):
    p = tmp_path / "d.tsv"
    p.write_text("# head\nکتاب\tकिताब\tkitaab\tkitāb\nx\ty\n\t\t\t\nخط\tख़त\tkhat\txat\textra\nخط\tख़त\tzzz\txat\n", encoding="utf-8")
    assert rows(readers.exact_dictionary(spark, str(p)), "urdu") == [("خط", "ख़त", "zzz", "xat"), ("کتاب", "किताब", "kitaab", "kitāb")]
    assert readers.exact_dictionary(spark, str(tmp_path / "none.tsv")).count() == 0
    f = tmp_path / "fixes.txt"
    f.write_text("a | b\n# c | d\nx|.|r|p\n", encoding="utf-8")
    assert rows(readers.fixes(spark, str(f)), "urdu") == [("a", "b", None, None, None), ("x", ".", "r", "p", None)]
    c = tmp_path / "log.tsv"
    c.write_text("# log\nكتاب\tएक\nکتاب\tदो\tdo\n\nx\t\n", encoding="utf-8")
    assert rows(readers.corrections(spark, str(c))) == [("کتاب", "दो", "do")]
    g = tmp_path / "gt.txt"
    g.write_text("a.png\tone\ttwo\nbroken\n", encoding="utf-8")
    assert rows(readers.labels(spark, str(g))) == [("a.png", "one\ttwo")]


def test_json_tables(spark, tmp_path):
    p = tmp_path / "lex.json.gz"
    with gzip.open(p, "wt", encoding="utf-8") as fh:
        json.dump({"كتاب": ["किताब", "kitaab"], "x": ["a"], "y": ["", "b"]}, fh, ensure_ascii=False)
    assert rows(readers.lexicon(spark, str(p))) == [("کتاب", "किताब", "kitaab")]
    w = tmp_path / "w.json"
    w.write_text(json.dumps({"a": {"x": 1.5, "y": 2}}), encoding="utf-8")
    assert rows(readers.weights(spark, str(w)), "value") == [("a", "x", 1.5), ("a", "y", 2.0)]
    v = tmp_path / "v.json"
    v.write_text(json.dumps({"a": ["x", "y"], "b": []}), encoding="utf-8")
    assert rows(readers.listed(spark, str(v)), "value") == [("a", "x"), ("a", "y")]
    t = tmp_path / "t.json"
    t.write_text(json.dumps({"lines": {"l": ["d", "p", None]}, "words": {}, "ctx": {"L\ta\tb": ["d", None, ""]}, "joins": {"a\tb": ["-", None, " "]}, "merge": {}, "future_merge": {"گا": [0.5, 1, 0]}, "o_join": ["-", "-", "-"]}), encoding="utf-8")
    got = readers.distilled(spark, str(t))
    assert rows(got["lines"]) == [("l", "d", "p", None)] and rows(got["context"]) == [("L", "a", "b", "d", None, "")] and rows(got["joins"]) == [("a", "b", "-", None, " ")]
    assert rows(got["future"]) == [("گا", [0.5, 1.0, 0.0])] and got["words"].count() == 0
    j = tmp_path / "rows.jsonl"
    j.write_text('{"id": "1", "x": 1}\nnot json\n{"id": "2", "x": 2}\n{"id": "1", "x": 3}\n', encoding="utf-8")
    assert rows(readers.json_lines(spark, str(j), "id string, x int", "id"), "id") == [("1", 3), ("2", 2)]
    assert readers.json_lines(spark, str(j), "id string, x int").count() == 3
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as out:
        out.writestr("train/a.json", '{"s": "x"}\n{"s": "y"}\n')
        out.writestr("readme.txt", "no")
    assert rows(readers.zipped_json(spark, str(z), "*.json", "s string"), "s") == [("x",), ("y",)]


def test_corpora_and_pages(spark, tmp_path):
    p = tmp_path / "aligned.txt"
    p.write_text("a\tx\nb\ty\n</s>\n\nc\tz\n", encoding="utf-8")
    assert [r[1:] for r in rows(readers.separated_sentences(spark, str(p)), "sentence", "pos")] == [(0, 0, "a", "x"), (0, 1, "b", "y"), (1, 0, "c", "z")]
    wiki = "x<poem>\n:دل [[ربط|ناداں]] {{سانچہ}}<ref>a</ref>\n\nlatin line\n''تجھے'' ہوا\n</poem>"
    assert spark.createDataFrame([(wiki,)], "w string").select(readers.poem_blocks(F.col("w")).alias("p")).first().p == ["", "دل ناداں", "", "تجھے ہوا", ""]
    page = "<div class='pMC' data-roman='off'><div class='c'><p><span data-m='1'>دل</span><span data-m='1'>ناداں</span> <span data-m='2'>تجھے</span></p></div></div><div class='pMC' data-roman='on'>x</div>"
    got = spark.createDataFrame([(page,), (None,)], "h string").select(readers.verse_lines("h").alias("v")).collect()
    assert got[0].v[0].line == "دلناداں تجھے" and [(u.id, u.text) for u in got[0].v[0].units] == [("1", "دل ناداں"), ("2", "تجھے")] and got[1].v is None
    (tmp_path / "keys").write_text("# c\nA=1\nB = 'x y'\n\n", encoding="utf-8")
    assert readers.key_file(str(tmp_path / "keys")) == {"A": "1", "B": "x y"}
    lines = spark.createDataFrame([("t", "دل ہی تو ہے، نہ")], "title string, line string")
    wiki_ = spark.createDataFrame([("یہ کتاب ہے",), ("اکیلا",), ("ى ى ى ى",)], "line string")
    got = rows(readers.label_items(lines, wiki_, lines.selectExpr("'dev' AS split", "line"), spark.createDataFrame([("قلم",), ("دو لفظ",)], "word string")), "src", "run")
    assert [(s, r) for s, _, r in got] == [("dak", "دل ہی تو ہے"), ("dak", "نہ"), ("poem", "دل ہی تو ہے"), ("poem", "نہ"), ("wiki", "یہ کتاب ہے"), ("word", "قلم")]
    assert rows(readers.sentence_corpus(spark.createDataFrame([("یہ ایک کتاب ہے۔ دو لفظ۔ یہ ایک کتاب ہے",)], "t string"), "t")) == [("یہ ایک کتاب ہے",)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", "y", 1), ("a", "x", None, 5)], "k string, v string, w string, n int")
    writers.lexicon_json(df, str(tmp_path / "lex"), "k", ["v", "w"])
    assert sorted(r.key for r in spark.read.json(str(tmp_path / "lex")).collect()) == ["a", "b"]
    writers.dictionary_tsv(df, str(tmp_path / "dic"), ["k", "v", "w"], "n")
    assert [r.value for r in spark.read.text(str(tmp_path / "dic" / "body")).collect()] == ["a\tx\t", "b\tx\ty"]
    train = writers.training_rows(spark.createDataFrame([("t", "s", "g", 3.0), ("t", "s", "g", 3.0)], "task string, src string, tgt string, weight double"))
    assert rows(train) == [("t", "s", "g", "4.00")]
    writers.training_tsv(train.withColumn("split", F.lit("dev")), str(tmp_path / "train"), "split")
    assert spark.read.text(str(tmp_path / "train" / "split=dev")).first().value == "t\ts\tg\t4.00"
    one = spark.createDataFrame([("1", "a"), ("1", "a")], "id string, x string")
    writers.append_new(one, str(tmp_path / "log"), "id")
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    writers.append_new(one.unionByName(spark.createDataFrame([("2", "b")], "id string, x string")), str(tmp_path / "log"), "id")
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    log = spark.createDataFrame([("k", "old", 1)], "key string, v string, at int")
    assert rows(writers.upserted(log, log.selectExpr("key", "'new' AS v", "2 AS at"), ["key"], ["at"])) == [("k", "new", 2)]
    pics = spark.createDataFrame([("train", "a.png", bytearray(b"x"), "ایک\tدو"), ("val", "b.png", bytearray(b"y"), "تین")], "split string, file string, content binary, text string")
    writers.image_sets(pics, str(tmp_path / "pics"), "split", "file", "content", "text")
    assert (tmp_path / "pics" / "train" / "images" / "a.png").read_bytes() == b"x"
    assert spark.read.text(str(tmp_path / "pics" / "labels" / "split=train")).first().value == "images/a.png\tایک دو"
    assert rows(writers.recognition_labels(spark.createDataFrame([("a.png", "x"), ("b.png", "")], "file string, text string"), "paddle", "root")) == [("root/a.png\tx",)]
    titles = spark.createDataFrame([("a",), ("b",), ("c",)], "title string")
    done = spark.createDataFrame([("a", "e"), ("b", None)], "title string, entry string")
    assert rows(writers.accepted(titles, done, 5)) == [("c",)] and writers.accepted(titles, done, 1).count() == 0
    assert writers.missing_references(titles, done, "title").count() == 1


def test_streams(spark, tmp_path):
    rows_ = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, at int")
    rows_.write.parquet(str(tmp_path / "in" / "1"))
    source = lambda: spark.readStream.schema(rows_.schema).parquet(str(tmp_path / "in" / "*"))

    def run():
        updates.follow(source(), ["k"], ["at"], str(tmp_path / "t"), str(tmp_path / "p"), 4).awaitTermination()
        return rows(updates.current(spark, str(tmp_path / "t"), rows_.schema), "k")

    assert run() == [(1, "b", 2), (2, "c", 1)]
    spark.createDataFrame([(2, "d", 5), (1, "z", 0), (3, "e", 1)], rows_.schema).write.parquet(str(tmp_path / "in" / "2"))
    assert run() == [(1, "b", 2), (2, "d", 5), (3, "e", 1)]
    seen = []
    updates.emit(source(), lambda part: seen.append([r.k for r in part]), str(tmp_path / "e"), F.col("k"), 2).awaitTermination()
    assert seen[-1] == [] and sorted(k for part in seen for k in part) == [1, 1, 1, 2, 2, 3]
    told = []
    p = updates.Progress(told.append)
    spark.streams.addListener(p)
    updates.build_once(source(), ["k"], lambda df: df, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    spark.streams.removeListener(p)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3 and told[0] == {"progress": 0}


def test_errors_of_short_and_long_texts(spark):
    from tarkib.functions import metrics

    texts = [("", ""), ("", "ab"), ("ab cd", "ab xd"), ("ب" * 300 + " x", "ب" * 299 + " y"), ("a b " * 200, "a c " * 200), (None, "a")]
    df = spark.createDataFrame(texts, "r string, h string")
    got = df.select(metrics.char_errors(F.col("r"), F.col("h")).alias("c"), metrics.cer(F.col("r"), F.col("h")).alias("e"), metrics.wer(F.col("r"), F.col("h")).alias("w")).collect()
    assert [x.c for x in got] == [0, 2, 1, 2, 200, None] and [x.e for x in got][:3] == [0.0, 1.0, 0.2] and [x.w for x in got][:5] == [0.0, 1.0, 0.5, 1.0, 0.5]


def test_engines_and_recognition(spark):
    r = engines.Registry()
    r.add(engines.Engine("slow", "translit", "Slow", lambda x: __import__("time").sleep(3) or "x"))
    r.add(engines.Engine("up", "translit", "Up", str.upper))
    df = spark.createDataFrame([("a",)], "t string")
    got = {x.provider_id: (x.ok, x.value) for x in engines.run_all(df, "t", r, "translit", ["up", "slow", "none"], 0.5).collect()}
    assert got == {"up": (True, "A"), "slow": (False, None), "none": (False, None)}
    assert [x.t for x in engines.as_completed(df)] == ["a"] and r.frame(spark).count() == 2

    def read(content, options):
        if content == b"bad":
            raise ValueError("no")
        return [("دنیا", [(0, 0), (10, 0), (10, 9), (0, 9)], 0.5), ("كتاب", [(50, 0), (70, 0), (70, 9), (50, 9)], 0.5)]

    pages = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"bad"))], "page int, content binary")
    got = {x.page: (x.ok, x.text, x.error) for x in layout.recognised(pages, "page", read).collect()}
    assert got == {1: (True, "کتاب دنیا", None), 2: (False, None, "ValueError: no")}
    answer = spark.createDataFrame([('{"words": [{"text": "a", "box": [{"x": 1, "y": 2}], "conf": 0.5}, {"text": null}]}',), ("no",), (None,)], "j string")
    assert [len(x.w) for x in answer.select(layout.parsed_boxes(F.col("j")).alias("w")).collect()] == [1, 0, 0]
    assert sequences.epoch_sample(spark.range(50).selectExpr("id", "'a' AS t"), "t", {"a": 7}, 3).count() == 7
    assert sequences.repeated(df, F.lit(3)).count() == 3
