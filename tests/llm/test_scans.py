def test_scanned_lines(spark):
    from tarkib.llm import scans

    body = ["وہ کتاب پڑھتا ہے اور شہر دیکھتا ہے", "یہ دریا بہت بڑا ہے اور پرانا در-", "خت اس کے پاس ہے۔"]
    lines, results = [], []
    for page in range(4):
        for engine in range(3):
            rid = page * 10 + engine
            results.append((rid, page))
            text = ["باغ بہار", *body, "۱۲" if page else "باغ بہار ۱۳"]
            if (page, engine) == (1, 2):
                text[1] = text[1].replace("شہر", "سہر")
            if (page, engine) == (2, 0):
                text[2] = text[2].replace("دریا", "در9ا")
            lines += [(rid * 10 + n, rid, "b", n, t, 0.9) for n, t in enumerate(text)]
    ls = spark.createDataFrame(lines, "line_id long, result_id long, book_id string, line_no int, text string, conf double")
    rs = spark.createDataFrame(results, "result_id long, page_id long")
    known = spark.createDataFrame([(w,) for t in body for w in t.split()], "urdu string")
    got = {(r.line_id, r.kind) for r in scans.found(ls, rs, known).collect()}
    rids = [p * 10 + e for p in range(4) for e in range(3)]
    want = {(r * 10, "header") for r in rids} | {(r * 10 + 2, "hyphen") for r in rids} | {(r * 10 + 4, "page_number") for r in rids}
    want |= {(r * 10 + 4, "header") for r in rids if r < 10} | {(121, "misread"), (202, "misread")}
    assert got == want
    pages = {r.page: r.text for r in scans.pages(ls, rs, known).collect()}
    assert len(pages) == 4
    assert set(pages.values()) == {"وہ کتاب پڑھتا ہے اور شہر دیکھتا ہے یہ دریا بہت بڑا ہے اور پرانا درخت اس کے پاس ہے۔"}
