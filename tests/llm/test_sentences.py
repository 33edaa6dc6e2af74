import numpy as np
import pytest
from changeflow.llm import sentences as S

#: Texts with | where one sentence ends and the next begins; a model without training decides them by their form.
CASES = [
    ("A first one?| And a second!|Third one", None),
    ("One\nline break inside.\n\nAnother block without a mark\n\n* item one\n* item two? Yes.", ["One\nline break inside.", "Another block without a mark", "item one", "item two?", "Yes."]),
    ("== Heading. Not one! ==\nText here!\n----\n__NOTOC__\n[[File:a.jpg|thumb|A view. From here.]]\n[[Category:X]]\n{{quote box|text=A. B! {{small|C?}}|by=D}}\n<!-- No. Nothing! -->\nMore!", ["Text here!", "More!"]),
    ('{| class="wikitable"\n! A !! B\n|-\n| x. || y?\n|}\nAfter!', ["After!"]),
    ("#REDIRECT [[Target]] {{R from move. See log.}}", []),
    ("# First!\n# Second?", ["First!", "Second?"]),
    ("“Stop! Go back!” cried the keeper. ", ["“Stop! Go back!” cried the keeper."]),
    ('He said: "It fell. It broke!"| Then what?', None),
    ("The mill (“What next? Who knows!”) closed!| Yes!", None),
    ("Really!<ref>{{cite book|title=Why?}}</ref>[1]| Next?{{citation needed|date=May 2024}}| Last!", None),
    ("See http://a.example.org/x.php?id=2 for it!| Yes!", None),
    ("Yahoy! is a ferry!?!| Next!", None),
    ("It fell... or so they said...| Then it rose!", None),
    ("''Why Now? A Life'' is a novel!| Yes!", None),
    ("多么著名的山谷！|“港口在哪里？”山白问。|他说:“关闭了。走吧。”|《河志。桥篇》记载。", None),
    ("「駅は消えた。」と書いた。|本当か？", None),
    ("«Стой! Назад!» — крикнул он!| Да!", None),
    ("—¿Dónde está? —preguntó él!| ¡Qué torre!", None),
    ("यह पुल है।| डॉ. रिवी ने कहा, “पुल बंद हुआ। अब चलो।”| मंदिर कहाँ?", None),
    ("Ποιος έχτισε το μύλος;| «Πού είναι;» ρώτησε ο Λο;", None),
    ("من بنى الجسر؟| أين السوق؟", None),
    ("สะพานยาว 98.8 กิโลเมตร| ผู้คนเรียกป้อมต่าง ๆ ว่า eLo ในภาษา| ใครสร้าง[[พูลี (พูมะ)|พูลี]]นี้", None),
    ("​ Zero width!​ | Next!", None),
    ("The {{convert|1|km}} way!\r\nNext line?\r\n\r\nBlock", ["The {{convert|1|km}} way!", "Next line?", "Block"]),
    ("Unclosed (bracket! Next “quote! End", ["Unclosed (bracket!", "Next “quote!", "End"]),
    ("Cut {{template|a. b! c", ["Cut {{template|a. b! c"]),
    ("Text!\n\n[[Cate", ["Text!"]),
    ("Text!\n== Hist", ["Text!"]),
    ("", []), ("  \n​\n", []), (None, []),
]


@pytest.fixture(scope="module")
def blank():
    return S.Model(S.Counts(np.zeros((6, S.BUCKETS), np.int64)), S.prior())


@pytest.mark.parametrize("i", range(len(CASES)))
def test_form(blank, i):
    text, want = CASES[i]
    if want is None:
        # "|" divides, but not within markup.
        parts = S.regex.split(r"\|(?![^\[{]*[\]}])", text)
        text, want = "".join(parts), [p.strip(" \u200b\r\n") for p in parts]
    got = [text[s:e] for s, e in blank.sentences(text)]
    assert got == want


def corpus():
    """Texts in which abbreviations, names and plain words take all the places they can."""
    import random

    r = random.Random(2)
    name = lambda: "".join(r.choice(["bel", "tor", "nar", "vi", "ka", "lo"]) for _ in range(r.randint(2, 4))).capitalize()
    kinds = [
        lambda: f"Capt. {name()} left {name()} in {r.randint(1000, 1999)}.", lambda: f"The stone came from the {name()} Mts.", lambda: f"It lies {r.randint(1, 99)}.{r.randint(1, 9)} km from {name()}, near St. {name()} and the mill.",
        lambda: f"The last ferry left at {r.randint(1, 12)} p.m.", lambda: f"Trade ended at {r.randint(1, 12)} p.m. and never resumed.", lambda: "They bought ropes, nails, etc.", lambda: f"{name()} held a post, etc., in {name()}.",
        lambda: f"No. {r.randint(1, 30)} was the mill of {name()}.", lambda: f"The code cites No. {r.randint(1, 30)} and Sept. {r.randint(1, 30)} of the law.",
    ]
    out = []
    for _ in range(700):
        gold, text = [], ""
        for _ in range(r.randint(1, 4)):
            for i in range(r.randint(1, 4)):
                s = r.choice(kinds)()
                text += (" " if i else "") + s
                gold.append(s)
            text += "\n\n"
        out.append((text, gold))
    return out


def test_the_model_learns_abbreviations():
    docs = corpus()
    sums = np.zeros((6, S.BUCKETS), np.int64)
    for text, _ in docs[:500]:
        S.count(text, sums)
    counts = S.Counts(sums)
    model = S.Model(counts, S.fit([x for text, _ in docs[:500] for x in S.labelled(text, counts)]))
    right = wrong = 0
    for text, gold in docs[500:]:
        got = [text[s:e] for s, e in model.sentences(text)]
        both = len(set(got) & set(gold))
        right += both
        wrong += len(set(got) | set(gold)) - both
    assert right / (right + wrong) > 0.97


def test_on_spark(spark):
    docs = [(i, t) for i, (t, _) in enumerate(corpus()[:200])] + [(900, None), (901, ""), (902, " \n"), (903, "Twice! Yes!"), (903, "Twice! Yes!"), (None, "No id! None.")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "0 as start_pos", "'x' as y")
    rows = S.split(df).collect()
    text = dict(docs)
    for r in rows:
        part = text[r.doc_id][r.start_pos : r.end_pos]
        assert part and part == part.strip()
    assert sum(r.doc_id == 903 for r in rows) == 4 and not any(r.doc_id in (900, 901, 902) for r in rows)
    assert sum(r.doc_id is None for r in rows) == 2
    for d in (1, 2, 3):
        spans = sorted((r.start_pos, r.end_pos) for r in rows if r.doc_id == d)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert S.split(df.limit(0)).count() == 0


def test_a_long_text(blank):
    text = "The mill burned! " * 20_000
    assert len(blank.sentences(text)) == 20_000
    assert len(blank.sentences("(" * 5_000 + " x! " + "Burned! " * 5_000)) == 5_001


def test_tokens_whose_hashes_collide_are_counted_apart(spark):
    import zlib

    seen = {}
    for i in range(10_000):
        b = "zq" + "".join(chr(97 + int(d)) for d in str(i))
        a = seen.setdefault(zlib.crc32(f"en|{b}".encode()) % S.BUCKETS, b)
        if a != b:
            break
    assert a != b
    texts = [f"They met Mr {'ab'[i % 2] * (i + 3)} of {a}. Then they left for {i}." for i in range(9)] + [f"It was near {b}.", f"The mill of {b}. Zed left it."]
    counts = S.corpus_counts(S.analysis(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")))
    assert counts.left(a, "en")[0] > S.LEAST_LEFT and counts.left(a, "en")[1] == 0
    assert counts.left(b, "en") == (0, 1.0)  # one surrounding: as good as never met
    sums = np.zeros((6, S.BUCKETS), np.int64)
    for t in texts:
        S.count(t, sums)
    assert counts.totals == sums[:4].sum(1).tolist() and counts.rate == S.Counts(sums).rate


def test_training_does_not_depend_on_the_order_of_documents_where_examples_are_cut(spark, monkeypatch):
    import inspect

    options = inspect.signature(S.fit_arrays).parameters
    assert (options["rounds"].default, options["batch"].default) == (12, 256)
    kept = []
    monkeypatch.setattr(S, "EXAMPLES", 1)
    monkeypatch.setattr(S, "fit_arrays", lambda y, x: kept.append((y, x)) or np.zeros(S.DIMS))
    texts = [(i, t) for i, (t, _) in enumerate(corpus()[:120])]
    df = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    counts = S.corpus_counts(S.analysis(df(texts)))
    for rows, parts in ((texts, 1), (texts[::-1], 3)):
        S.train(S.analysis(df(rows).repartition(parts)), counts, 60, sample=60)
    one, two = (sorted(zip(y.tolist(), x.tolist(), strict=True)) for y, x in kept)
    assert one == two and len(one) == 60
    every = []
    for r in df(texts).select("text", S.F.xxhash64("doc_id", "text").alias("h")).collect():
        examples = S.labelled(r.text, counts)
        every += zip(S.place_hashes(r.h, len(examples)), examples, strict=True)
    assert len(every) > 60 and one == sorted((y, x) for _, (y, x) in sorted(every)[:60])


def test_the_share_of_a_huge_corpus_has_a_threshold(spark, monkeypatch):
    """A sample of 10^10 documents isn't empty where a document's hash is low enough, and no size rounds the share to nothing."""
    texts = [(i, t) for i, (t, _) in enumerate(corpus()[:120])]
    found = S.analysis(spark.createDataFrame(texts, "doc_id bigint, text string"))
    counts = S.corpus_counts(found)
    taken = []
    monkeypatch.setattr(S, "fit_arrays", lambda y, x: taken.append(len(y)) or S.prior())
    low = found.withColumn("h", S.F.lit(-(1 << 63) + 1).cast("bigint"))
    S.train(low, counts, 10**10, sample=8_000)
    S.train(found, counts, 240, sample=120)
    assert taken[0] > 500 and 0.25 * taken[0] < taken[1] < 0.75 * taken[0]


def test_what_is_stored_decides_as_the_text_does(spark):
    docs = [(i, t) for i, (t, _) in enumerate(corpus()[:60])] + [(1000 + i, "".join(S.regex.split(r"\\|(?![^\\[{]*[\\]}])", t))) for i, (t, _) in enumerate(CASES) if t]
    docs += [(i + 5000, t) for i, t in docs[:30]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    models = []
    fit = S.train
    S.train = lambda *a, **k: models.append(fit(*a, **k)) or models[-1]
    try:
        got = {}
        for r in S.split(df).collect():
            got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    finally:
        S.train = fit
    assert {d: sorted(x) for d, x in got.items()} == {d: x for d, t in docs if (x := models[0].sentences(t))}


def test_forgetting_blocks_changes_nothing(blank, monkeypatch):
    texts = [t for t, _ in corpus()[:40]]
    want = [blank.sentences(t) for t in texts]
    monkeypatch.setattr(S, "MOST_KEPT", 10)
    S._FOUND.clear()
    assert [blank.sentences(t) for t in texts] == want and len(S._FOUND) <= 1


def test_forms_and_their_indexes():
    assert len(S._FORM_INDEX) < S.FORMS and len({*S._FORM_INDEX.values()}) == len(S._FORM_INDEX)
    w = S.prior()
    assert all((w[i] > 0) == (S._VERDICTS[f] == 1) and (w[i] < 0) == (S._VERDICTS[f] == 0) for f, i in S._FORM_INDEX.items())
