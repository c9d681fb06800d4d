"""Account numbers before upper-case words and digits."""

from kinweave.llm import pii


def test_iban_ends_at_its_length(spark):
    texts = ["IBAN DE89370400440532013000 BIC COBADEFFXXX", "IBAN DE89370400440532013000 2024 paid", "konto DE89 3704 0044 0532 0130 00 BIC X", "IBAN GB82 WEST 1234 5698 7654 32, OK", "IBAN NO9386011117947 DE89370400440532013000", "IBAN DE89370400440532013001 BIC", "IBAN DE89370400440532013000X"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "iban"] for r in pii.find_pii(docs).collect()}
    german = "DE89370400440532013000"
    assert found == {0: [german], 1: [german], 2: ["DE89 3704 0044 0532 0130 00"], 3: ["GB82 WEST 1234 5698 7654 32"], 4: ["NO9386011117947", german], 5: [], 6: []}
