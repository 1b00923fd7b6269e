"""Secret scans on the secrets planted in documents, and on passwords and what is mistaken for them."""

import re

import pytest

from ledgerlens.llm import secret_scan as s
from ledgerlens.llm.common import documents

CHOSEN = {
    "password = S3cr3tPw9": "S3cr3tPw9", "pwd=hunter2abc!x": "hunter2abc!x", 'passwd: "Tr0ub4dor&3x"': "Tr0ub4dor&3x", "the secret is Xk9!mm2Qz": "Xk9!mm2Qz",
    "Zq8kLm2Rt9XvBn4Ps7Wd is the api_key of": "Zq8kLm2Rt9XvBn4Ps7Wd", 'secret="a!B@c#D$e%F7g8H9"': "a!B@c#D$e%F7g8H9",
}
PLAIN = ["the secret garden of the", "password required here", "token = null or none", "password: ********", "password = <password>", "token = therenand.", "The secret: theirs."]


@pytest.fixture(scope="module")
def model(spark):
    return s.train(spark)


def test_planted_in_documents(spark, sf, model):
    docs = documents(spark, sf.replace("sf0.001", "sf0.01"))
    planted = {(r.doc_id, x) for r in docs.collect() for x in re.findall(r'token = "([0-9a-f]{40})"', r.text or "")}
    found = {(r.doc_id, r.secret) for r in s.secret_scan(docs, model).collect()}
    assert planted and len(found & planted) >= 0.95 * len(planted) and len(found & planted) >= 0.9 * len(found)


def test_chosen_passwords(spark, model):
    rows = [(i, t) for i, t in enumerate(CHOSEN)] + [(100 + i, t) for i, t in enumerate(PLAIN)]
    got = s.secret_scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.secret for r in got} == dict(enumerate(CHOSEN.values()))
