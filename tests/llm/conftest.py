import pytest

#: Nulls, empty and blank texts, ties, short and long runs, and characters of one to four bytes.
ODD_TEXTS = [
    None, "", " \t\n ", "one", "a b c", "A B C d e f g h i j k l", "...", "###", "\x1f\x85 x y z 　", "Éa Émile naïve ﬁ ß İstanbul é \U0001f600 \U0001f600!",
    "don't I'm we've <|endoftext|> x<|startoftext|>y 12 3.5 a1b2", "word " * 300, "x" * 5000, "1 " * 200 + "+1 (499) 555-6503", "Line\n" * 40 + "end",
    "mail a.b@c.d.e, x@y@z.com a@b.c+d@e.f @@ me@host 😀 q@r.s", "1.2.3.4.5 256.1.1.1 001.002.003.255 9.9.9 1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 49927398716 12345678901234567890123",
    "+1-2 +12345678 +123456789 +1 (234) 567.8901-2345 ++49 30 123456 +49 30 123456)", "call 555-123-4567 GB82 WEST 1234 5698 7654 32 ssn 123-45-6789 token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e06\"",
    "5" * 400 + " " + "7 " * 300, "a@" * 200, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf at night " * 4, "THE QUICK brown fox jumps over the lazy dog and runs away from the big bad wolf at night " * 4,
]


@pytest.fixture(scope="session")
def sample(spark):
    """Whole documents of the smallest tables and the odd texts, as rows of (doc_id, text, lang, source)."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    n = max(r[0] for r in rows) + 1
    return rows + [(n + i, t, "en" if i % 3 else None, None if i % 4 == 0 else "src0") for i, t in enumerate(ODD_TEXTS * 2)]


@pytest.fixture(scope="session")
def sample_dir(spark, sample, tmp_path_factory):
    """The sample as a folder of tables, with extra columns whose names operators use inside."""
    path = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket int, spans string, key double"
    rows = [(i, t, l, s, len(t or ""), 1, 2, "x", 0.5) for i, t, l, s in sample]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "lazy dog"), (902, "lazy dog"), (None, "big bad wolf"), (903, "brown FOX jumps over the lazy dog and runs away from the big")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)
