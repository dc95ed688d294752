"""Every query with an SQL twin gives the twin's rows on small tables with odd ones among them."""

import datetime as dt
import decimal
import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tarkib import plans
from tarkib.plans import registry

plans.load()
T0 = dt.datetime(2026, 1, 1)
BOX = [{"x": 10, "y": 5}, {"x": 90, "y": 5}, {"x": 90, "y": 25}, {"x": 10, "y": 25}]


def times(n):
    return [T0 + dt.timedelta(minutes=i % 3) for i in range(n)]


def tables() -> dict[str, tuple[list[tuple], list[tuple[str, pa.DataType]]]]:
    s, i, b, f, ts = pa.string(), pa.int64(), pa.bool_(), pa.float64(), pa.timestamp("us")
    texts = ["دل ہی تو ہے، نہ سنگ و خشت؟ کیا گیا۔ میں", "", None, "  \n\n ", "<b>یہ</b> &amp; [[a|کتاب]] {{x}}\n\nاس نے یہ کیا ہے۔\nyeh kitaab hai", "كتاب ١٢٣ کِتاب گئے", "Every day every Man\nthe Man", "کل آبادی کل\r\nسو گیا! بن گیا", "क़िताब सम्बन्ध‍"]
    train = [(1, "word", "کتاب", "किताब", 1.5, "gold"), (1, "word", "کتاب", "किताब", 1.5, "gold"), (2, "word", "کتاب", "कताब", 1.5, "wiki"), (3, "line", "یہ کتاب ہے", "ये किताब है", 0.4, "poem"), (4, "casual", "یہ کتاب", "yeh kitaab", 2.0, None), (5, "casual", "خوشبو", "khush-bu", None, "casual"), (6, None, None, None, None, None), (7, "word", "", "x", 1.0, "gold"), (8, "line", "یہ کتاب ہے", "ये कताब है", 0.4, "poem"), (9, "word", "كِتابيں", "किताबें ١", 9.0, "silver")]
    train += [(20 + k, "line", "وہ کتاب", "वो पुस्तक", 1.0, "poem") for k in range(3)]
    test = [(1, "test", "gold", "کتاب", "kitaab", "किताब"), (2, "dev", None, "یہ کتاب ہے۔", "ye kitaab hai", "ये किताब है"), (3, "dev", "wiki", None, None, None), (4, "test", "", "", "", ""), (5, "dev", "poem", "کتاب", "kitab", "कताब")]
    results = [(k, 1 + k % 3, p, k % 4 != 0, None, 50 * k, d, r, None) for k, (p, d, r) in enumerate([("ravi", "किताब", "Kitaab"), ("jhelum", "कताब", "kitab"), ("ravi", "किताब", "kitaab !"), ("gomal", None, None), ("ravi", "", " "), ("jhelum", "किताब", "kitaab"), ("chenab", "ये किताब", "ye  kitaab"), ("ravi", "x", "ye kitab")])]
    labels = [(1, "x", "poem", "t", "یہ کتاب", "ये किताब", "یہ کتاب"), (2, None, " Wiki", None, "کتاب", "", None), (3, "y", "dak", "test", None, None, None), (4, "z", "word", "", "کتاب", "किताब", "کتاب"), (1, "x", "poem", "t", "یہ کتاب", "ये किताब", "یہ کتاب")]
    dictionary = [("کتاب", "किताब", "kitāb", "kitaab", "kitāb", 90, "A"), ("یہ", "ये", "ye", "ye", "ye", 500, "A"), ("خط", "ख़त", "xat", "khat", None, 60, "B"), (None, "x", None, "x", None, None, "C"), ("کتب", None, None, "kutub", "kutub", 70, "A")]
    ocr = [(1, 1, "b", "sutlej-ocr", True, None, 9, "کتب  ، ١٢\n\n یہ", ""), (2, 1, "b", "kabul-ocr", False, "timeout", 8, None, ""), (3, 2, "b", "swat-ocr", True, None, 7, "", None), (1, 1, "b", "sutlej-ocr", True, None, 9, "کتب  ، ١٢\n\n یہ", "")]
    lines = [(1, 1, "b", 0, "کتب", BOX, 0.5), (2, 1, "b", 1, "یہ", [], None), (3, 1, "b", 2, None, None, 0.75), (1, 1, "b", 0, "کتب", BOX, 0.5)]
    items = [(1, "کتاب", "word"), (2, "یہ کتاب ہے", "line"), (3, "قلم", "word"), (4, None, "word"), (1, "کتاب", "word")]
    return {
        "documents": ([(k, t, [None, "ur", "en"][k % 3], ["poem", None][k % 2], len(t or ""), [None, "w"][k % 2]) for k, t in enumerate(texts)], [("doc_id", i), ("text", s), ("lang", s), ("source", s), ("n_chars", i), ("slug", s)]),
        "train": (train, [("train_id", i), ("task", s), ("src", s), ("tgt", s), ("weight", f), ("origin", s)]),
        "test": (test, [("test_id", i), ("split", s), ("source", s), ("urdu", s), ("rich", s), ("deva", s)]),
        "translit_items": (items, [("item_id", i), ("urdu", s), ("kind", s)]),
        "translit_results": ([(*r, t) for r, t in zip(results, times(len(results)), strict=True)], [("result_id", i), ("item_id", i), ("provider_id", s), ("ok", b), ("error", s), ("ms", pa.int32()), ("devanagari", s), ("roman", s), ("roman_diacritic", s), ("created_at", ts)]),
        "teacher_labels": (labels, [("label_id", i), ("id", s), ("src", s), ("grp", s), ("ur", s), ("hi", s), ("back", s)]),
        "dictionary": (dictionary, [("urdu", s), ("deva", s), ("rich", s), ("plain", s), ("rekhta", s), ("freq", pa.int32()), ("tier", s)]),
        "providers": ([("ravi", "translit", "Ravi", "offline", None), ("gomal", "translit", "Gomal", "api", ""), ("b-ocr", "ocr", "b", "api", None), ("a-ocr", "ocr", "A", "offline", None)], [(n, s) for n in ("provider_id", "capability", "label", "kind", "note")]),
        "ocr_results": (ocr, [("result_id", i), ("page_id", i), ("book_id", s), ("provider_id", s), ("ok", b), ("error", s), ("ms", pa.int32()), ("text", s), ("notes", s)]),
        "ocr_lines": (lines, [("line_id", i), ("result_id", i), ("book_id", s), ("line_no", pa.int32()), ("text", s), ("box", pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))), ("conf", f)]),
    }


def write(folder, empty: bool):
    for name, (rows, kinds) in tables().items():
        schema = pa.schema(kinds)
        columns = list(zip(*rows, strict=True)) if not empty else [[] for _ in kinds]
        pq.write_table(pa.table([pa.array(list(c), t) for c, (_, t) in zip(columns, kinds, strict=True)], schema=schema), folder / f"{name}.parquet")


@pytest.fixture(scope="module", params=["odd", "empty"])
def data(request, tmp_path_factory):
    folder = tmp_path_factory.mktemp(request.param)
    write(folder, request.param == "empty")
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return str(folder), con, request.param


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if hasattr(v, "asDict"):
        v = list(v.asDict().values())
    if isinstance(v, dict):
        v = list(v.values())
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, name):
    folder, con, kind = data
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.SQL:
        assert len(set(map(repr, rows))) == len(rows)
        return
    rel = con.execute(registry.SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert rows == want


