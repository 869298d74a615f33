from quern.llm import decontam


def leaks(spark, docs, items):
    table = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} long, text string")
    return {(r.doc_id, r.item_id): (r.n_windows, r.n_found) for r in decontam.find_leaks(table(docs, "doc_id"), table(items, "item_id")).collect()}


def test_names_at_sentence_starts(spark):
    items = {
        1: "Tom has 3 apples. Tom gives 2 apples to Ann. How many apples does Tom have left?",
        2: "Natalia sold 48 clips in April. Natalia then sold half as many clips in May. How many did she sell?",
    }
    docs = {
        1: 'a sheet\nBob has 7 apples. Bob gives 4 apples to Eve. How many apples does Bob have left?',
        2: "(Maria sold 96 clips in June. Maria then sold half as many clips in July. How many did she sell?)",
        3: "Bob has 7 apples. Jim gives 4 apples to Eve. How many apples does Sue have left?",
    }
    found = leaks(spark, docs, items)
    assert set(found) == {(1, 1), (2, 2)} and all(n == k for n, k in found.values())


def test_short_items_and_copies_within_a_sentence(spark):
    items = {1: "What is seven times eight?", 2: "What is the capital city of northern Peru?", 3: "Name 7 primes.", 4: "12, 13", 5: "Explain osmosis", 6: "Solve the old riddle quickly"}
    docs = {
        1: "they said What is seven times eight?",
        2: "he asked What is the capital city of northern Peru? so they went",
        3: "now name 7 primes, or 12, 13",
        4: "please explain osmosis",
        5: "name 8 primes and explain the osmosis",
        6: "then she said Solve the old riddle quickly",
        7: None,
        8: "",
    }
    assert set(leaks(spark, docs, items)) == {(1, 1), (2, 2), (3, 3), (4, 5), (6, 6)}


def test_no_window_carries_a_long_text(spark, monkeypatch):
    item = "Tom has 3 apples. Tom gives 2 apples to Ann. How many apples does Tom have left?"
    words = [f"w{k % 900} {k}" for k in range(3000)]
    texts = {k: " ".join([*words[:at], item.replace("Tom", "Bob").replace("3", "7"), *words[at:]]) for k, at in enumerate((0, 100, 127, 128, 2999, 3000))}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = decontam.template_windows(frame, "doc_id").selectExpr("max(size(words)) most", "count(distinct id, pos) n", "count(*) n_rows").first()
    assert rows.most <= decontam.PIECE + decontam.WINDOW and rows.n == rows.n_rows > 36_000
    got = leaks(spark, texts, {1: item, 2: item})
    assert set(got) == {(k, i) for k in texts for i in (1, 2)} and all(n == m for n, m in got.values())
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)  # as if the benchmark were large
    assert leaks(spark, texts, {1: item, 2: item}) == got
