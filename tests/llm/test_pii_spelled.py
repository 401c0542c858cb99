"""Emails spelled without digit or @, and the decoder against plain Viterbi over whole texts."""

import numpy as np
from test_pii import brute_viterbi

from limnos.llm import pii_crf


def test_emails_in_words(spark):
    texts = ["please reach jane dot smith at example dot com for more of it", "reach the office by jane[at]example.com or by letter", "the words jane(at)example.com stand here"]
    want = ["jane dot smith at example dot com", "jane[at]example.com", "jane(at)example.com"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii_crf.find_pii(df).collect():
        a = r["text"].index(want[r["doc_id"]])
        assert r["pii"]["spans"] == f"email:{a}:{a + len(want[r['doc_id']])}", r


def test_whole_texts_decode_as_plain():
    crf = pii_crf.train(pii_crf.labelled_table(200), epochs=3)
    texts = [t for t, _ in pii_crf.labelled_table(25, seed=5)]
    fs = [pii_crf.features(*pii_crf.tokens(t)) for t in texts]
    first = np.concatenate([np.arange(len(f)) == 0 for f in fs])
    f = np.concatenate(fs)
    got = np.split(crf.label(f, first), np.cumsum([len(x) for x in fs])[:-1])
    for x, y in zip(fs, got, strict=True):
        assert list(y) == brute_viterbi(crf, x)
