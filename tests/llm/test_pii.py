"""Personal data: the base against plain patterns, the CRF against full Viterbi and held-out rows."""

import hashlib
import re

import numpy as np

from limnos.llm import pii_crf, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    "a.b@c.d@e.f x@y.z.", "@@ a@@b.c a@b", "x@y.z_q@r.st", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 12345678901234567890", "+1 (521) 555-2373 190.1.1.1 +12 +1 2345678- +123456789012345678",
    "é@b.c ü a+b%c@d-e.f-g-", "1" * 5000, "a" * 5000, "a@" * 2000, "1.2" * 900, "+1" * 900, "+1" + " " * 3000, "0000000000000000", "名前 foo@bar.com 1.1.1.1", "",
]


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits)))
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and total % 10 == 0) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_equals_plain_patterns(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for t in [*texts.values(), *HARD]:
        assert pii_crf.base_spans(t) == plain(t)
    for r in queries.op4_pii_crf(spark, "/root/testdata/sf0.001").collect():
        base = plain(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii_crf.joined(base).encode()).hexdigest()
        assert {f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(r["spans"].split(","))


def brute_viterbi(crf, f):
    e = crf.scores(f)
    step = np.where(crf.banned, -1e9, crf.step)
    best = {y: (step[0, y] + e[0, y], [y]) for y in range(e.shape[1])}
    for t in range(1, len(e)):
        best = {y: max(((s + step[p[-1], y] + e[t, y], [*p, y]) for s, p in best.values()), key=lambda x: x[0]) for y in range(e.shape[1])}
    return max(((s + step[p[-1], 0], p) for s, p in best.values()), key=lambda x: x[0])[1]


def test_crf():
    crf = pii_crf.train(pii_crf.labelled_table(), epochs=5)
    held = pii_crf.labelled_table(120, seed=99)
    base = [pii_crf.base_spans(t) for t, _ in held]
    more = pii_crf.added_spans(crf, [t for t, _ in held], base)
    want = [{(a, pii_crf.KINDS.index(k), b) for a, b, k in s} for _, s in held]
    got = [set(b) | set(m) for b, m in zip(base, more, strict=True)]
    hit = sum(len(w & g) for w, g in zip(want, got, strict=True))
    assert hit > 0.9 * sum(map(len, want)) and hit > 0.9 * sum(map(len, got))
    assert hit > 1.3 * sum(len(w & set(b)) for w, b in zip(want, base, strict=True))
    # Texts laid end to end decode like each text alone.
    fs = [pii_crf.features(*pii_crf.tokens(text)) for text, _ in held[:40]]
    first = np.concatenate([np.arange(len(f)) == 0 for f in fs])
    together = np.split(crf.label(np.concatenate(fs), first), np.cumsum([len(f) for f in fs[:-1]]))
    for f, y in zip(fs, together, strict=True):
        assert list(crf.decode([crf.scores(f)])[0]) == list(y)
    f = pii_crf.features(*pii_crf.tokens("call +1 (521) 555-2373 now 12 or 1.2.3.4 - 5"))
    assert list(crf.decode([crf.scores(f)])[0]) == brute_viterbi(crf, f)


def test_crf_gradient_and_likelihood():
    """Against the sum over all label sequences of a short text, and finite differences."""
    from itertools import product

    rng = np.random.default_rng(1)
    crf = pii_crf.CRF()
    crf.emit[:], crf.step[:] = rng.normal(0, 0.3, crf.emit.shape), rng.normal(0, 0.3, crf.step.shape)
    f = pii_crf.features(*pii_crf.tokens("call +15215552373 a@b.co 1.2.3.4"))
    y = np.array([0, 7, 1, 3])

    def total(labels):
        e = crf.scores(f)
        ok = not crf.first_banned[labels[0]] and not any(crf.banned[a, b] for a, b in zip(labels, labels[1:], strict=False))
        return sum(e[t, v] for t, v in enumerate(labels)) + sum(crf.step[a, b] for a, b in zip(labels, labels[1:], strict=False)) if ok else -np.inf

    z = np.logaddexp.reduce([total(p) for p in product(range(len(crf.LABELS)), repeat=len(f))])
    loss, g_emit, g_step = crf.gradient(f, y)
    assert abs(loss - (z - total(list(y)))) < 1e-6
    for w, g in ((crf.emit, g_emit), (crf.step, g_step)):
        places = [tuple(x) for x in np.argwhere(np.abs(g) > 1e-9)]
        for at in [places[i] for i in rng.choice(len(places), 25)]:
            w[at] += 1e-5
            up = crf.gradient(f, y)[0]
            w[at] -= 2e-5
            down = crf.gradient(f, y)[0]
            w[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_bound_rules_out_no_label():
    """Labels equal Viterbi's over whole texts for the trained field, and for random ones, of which many favour labels."""
    texts = [t for t, _ in pii_crf.labelled_table(25, seed=5)] + ["", "word", "1.2.3.4", "call +15215552373 or +15215552374 a@b.co c@d.ef"]
    fs = [f for t in texts if len(f := pii_crf.features(*pii_crf.tokens(t)))]
    first = np.concatenate([np.arange(len(f)) == 0 for f in fs])
    fields, rng = [pii_crf.train(pii_crf.labelled_table())], np.random.default_rng(6)
    for scale, drop in ((0.3, 0.0), (0.3, 0.4), (1.5, 1.0), (0.1, 2.0)):
        crf = pii_crf.CRF()
        crf.emit[:], crf.step[:] = rng.normal(0, scale, crf.emit.shape), rng.normal(0, 1.0, crf.step.shape)
        crf.emit[0, :, 1:] -= drop / 6
        fields.append(crf)
    bare = 0
    for crf in fields:
        y = crf.label(np.concatenate(fs), first)
        whole = np.concatenate(crf.decode([crf.scores(f) for f in fs]))
        assert (y == whole).all()
        bare += (~crf.may_bear(crf.scores(np.concatenate(fs), first))).sum()
    assert bare > 0.15 * len(first) * len(fields)


def test_cards_that_run_together(spark):
    crf = pii_crf.train(pii_crf.labelled_table())
    text = "pay 7536784127813050 4845168114407329 now"
    rows = [(1, text), (2, None), (3, ""), (4, "word " * 50_000 + "a@b.co"), (1, text)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, pii string")
    out = {r["doc_id"]: r["pii"] for r in pii_crf.find_pii(df, crf).collect()}
    assert out[1]["n_card"] == 0 and "card:4:20" in out[1]["spans"]
    assert out[2]["spans"] == out[3]["spans"] == "" and out[4]["spans"] == "email:250000:250006"
    assert pii_crf.find_pii(df.limit(0), crf).count() == 0
