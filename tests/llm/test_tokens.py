import tiktoken

from tarkib.llm import tokens

PATH = tokens.vocabulary_path("byte_bpe_50k")


def coder():
    return tiktoken.Encoding("t", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=tokens.ranks(PATH), special_tokens={}).encode_ordinary


TEXTS = ["یہ کتاب ہے، it's a book!  \n\n<|endoftext|> 12 ३४", "", None, "   ", "a" * 5000 + " " + "—" * 300, "क़िताब ‍‌ 🙂‍↔️ it'll", "\t x y\u0085z", "یہ کتاب ہے، it's"]


def test_ids_and_counts_of_all_words_and_of_few_in_the_head(spark):
    code = coder()
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], 1, "x"), (None, "a b", 1, "x")], "doc_id long, text string, h int, pos string")
    want = {k: code(t) if t else [] for k, t in enumerate(TEXTS)} | {None: code("a b")}
    for head in (tokens.HEAD_WORDS, 3):
        rows = tokens.encode_corpus(df, head_words=head).collect()
        assert len(rows) == len(want) and {r.doc_id: r.ids for r in rows} == want
    named = df.where("doc_id IS NOT NULL")
    assert {r.doc_id: r.tokens for r in tokens.token_counts(named, "doc_id", "text").collect()} == {k: len(v) for k, v in want.items() if k is not None}
    assert tokens.encode_corpus(df.where("false")).count() == 0


def test_round_trip(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS) if t], "doc_id long, text string")
    ids = tokens.encode_corpus(df).selectExpr("doc_id", "0L AS h", "ids")
    assert {r.doc_id: r.text for r in tokens.decode_corpus(ids).collect()} == {k: t for k, t in enumerate(TEXTS) if t}
