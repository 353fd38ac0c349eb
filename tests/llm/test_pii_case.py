from lodestar.llm import pii


def test_keywords_of_secrets_in_any_case(spark):
    texts = ['TOKEN = "1beb58b8af68854f0e01"', "Password: 7602ad27cf5550de1c", "api_KEY=7602ad27cf5550de1c"]
    got = [r.text for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key for tests").orderBy("doc_id").collect()]
    for old, new in zip(texts, got, strict=True):
        assert new != old and len(new) == len(old) and new[:8] == old[:8]
