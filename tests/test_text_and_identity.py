import hashlib
import json
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from proofweave import constants as K
from proofweave.functions import identity as ids
from proofweave.functions import stems, text as tx
from proofweave.functions.embedding import hash_embedder
from proofweave.functions.identity import ChunkerConfig
from proofweave.functions.spelling import corrected_query
from proofweave.operators import chunking

ALPHABET = "ab é.  \t\n\n\r\x0b\x0c\x1c\x1f\x85   　😀"


def random_texts(count, length, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, length))) for _ in range(count)]


def model_normalize(text):
    lines = [re.sub(r"[ \t\f\v]+", " ", line).strip() for line in text.splitlines()]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines).strip())


def test_normalisation_matches_a_plain_model(spark):
    texts = random_texts(300, 60) + ["a  b\t c\n\n\n\nd ", " \t\n", "plain text"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in frame.withColumn("out", tx.normalize_content(F.col("text"))).collect():
        assert row.out == model_normalize(row.text)


def test_windows_match_a_plain_model(spark):
    config = ChunkerConfig(size=64, overlap=63)
    texts = [model_normalize(t) for t in random_texts(20, 400, 3)] + ["x" * 5000]
    texts = [t for t in texts if t]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, normalized string")
    got = {}
    for row in chunking.split_documents(frame, config).orderBy("n", "ordinal").collect():
        got.setdefault(row.n, []).append((row.locator, row.content))
    for n, text in enumerate(texts):
        want, ordinal = [], 0
        for start in range(0, len(text), config.step):
            end = min(start + config.size, len(text))
            if text[start:end].strip():
                want.append((f"char:{start}-{end}:ordinal:{ordinal}", text[start:end].strip()))
                ordinal += 1
        assert got[n] == want


def test_chunker_configuration():
    assert ChunkerConfig(700, 100).hash_hex.startswith("f745a0ae0dc5bfeb")
    assert ChunkerConfig().hash_hex.startswith("9183e364d5c34418")
    for bad in ({"size": 63, "overlap": 0}, {"size": 64, "overlap": 64}, {"name": " "}, {"separators": ()}):
        with pytest.raises(ValueError):
            ChunkerConfig(**bad)


def test_config_hash_column_equals_the_constant(spark):
    row = spark.range(1).select(
        ids.config_hash(F.lit(700), F.lit(100), ChunkerConfig()).alias("h")
    ).first()
    assert row.h == ChunkerConfig(700, 100).hash_hex


def test_uuid5_and_json_match_the_standard_library(spark):
    texts = ['plain', 'é"\\\n\t', "😀 \x01\x7f"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t",
        ids.uuid5(K.VERSION_NAMESPACE, F.col("t")).alias("u"),
        ids.json_string(F.col("t")).alias("j"),
    )
    for row in frame.collect():
        assert row.u == str(uuid.uuid5(uuid.UUID(K.VERSION_NAMESPACE), row.t))
        assert row.j == json.dumps(row.t)


def test_repeated_passages_get_distinct_ids(spark):
    frame = spark.createDataFrame(
        [("00000000-0000-0000-0000-000000000001", "00000000-0000-0000-0000-0000000000aa", "v1",
          "Repeated passage. " * 200)],
        "enterprise_id string, document_id string, version_label string, text string",
    )
    first = [r.chunk_id for r in chunking.chunk_versions(frame, ChunkerConfig(128, 0)).collect()]
    again = [r.chunk_id for r in chunking.chunk_versions(frame, ChunkerConfig(128, 0)).collect()]
    other = [r.chunk_id for r in chunking.chunk_versions(frame, ChunkerConfig(128, 8)).collect()]
    assert len(first) == len(set(first)) and sorted(first) == sorted(again)
    assert not set(first) & set(other) and all(len(i) == 64 for i in first)


def test_blank_documents_are_set_aside(spark):
    frame = spark.createDataFrame([(1, " \n\t"), (2, "ok")], "n int, text string")
    assert [r.n for r in chunking.normalize_documents(frame).collect()] == [2]
    assert [r.n for r in chunking.blank_documents(frame).collect()] == [1]


def test_embedding_matches_a_plain_model(spark):
    texts = ["alpha beta beta 42", "ÉÀ", "one"]

    def model(text, size=64):
        values = [0.0] * size
        for token in re.findall("[a-z0-9]+", text.lower()) or [text.lower()]:
            d = hashlib.sha256(token.encode()).digest()
            weight = (1 if d[8] % 2 == 0 else -1) * (1 + d[9] % 31 / 100)
            values[int.from_bytes(d[:4], "big") % size] += weight
            values[int.from_bytes(d[4:8], "big") % size] += weight / 2
        norm = sum(v * v for v in values) ** 0.5
        return [v / norm for v in values]

    frame = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for row in frame.withColumn("e", hash_embedder(64)(F.col("t"))).collect():
        assert row.e == pytest.approx(model(row.t), abs=1e-6)
    with pytest.raises(ValueError):
        hash_embedder(4)


def test_spelling_and_focus(spark):
    cases = {
        "What are our retentin rules?": "What are our retention rules?",
        "Computer averages": "compute average",
        "short": None,
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    for row in frame.withColumn("c", corrected_query(F.col("t"))).collect():
        assert row.c == cases[row.t]
    focus = {
        "What are our retention rules?": "retention",
        "the cat": None,
        "retention": None,
        "Alpha bravo charlie delta9": "alpha bravo charlie",
    }
    frame = spark.createDataFrame([(t,) for t in focus], "t string")
    for row in frame.withColumn("f", tx.focused_query(F.col("t"))).collect():
        assert row.f == focus[row.t]


def test_english_word_forms(spark):
    # Words and stems published with the algorithm, one for each branch.
    published = """
        consign consign, consigned consign, consigning consign, consignment consign, consistency consist,
        consolation consol, consolingly consol, knavish knavish, kneeling kneel, knightly knight, knocked knock,
        generously generous, communication communic, arsenal arsenal, skies sky, dying die, early earli, news news,
        innings inning, exceeds exceed, caresses caress, ponies poni, ties tie, cries cri, gas gas, gaps gap,
        kiwis kiwi, this this, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing,
        conflated conflat, troubled troubl, hopping hop, hoping hope, falling fall, fizzed fizz, using use,
        filing file, cry cri, by by, say say, yes yes, enjoying enjoy, toyed toy, relational relat,
        conditional condit, rational ration, hesitanci hesit, vietnamization vietnam, operator oper,
        analogy analog, feudalism feudal, hopefulness hope, callousness callous, sensibility sensibl,
        rapidly rapid, silly silli, triplicate triplic, formative format, formalize formal, electrical electr,
        goodness good, adjustable adjust, replacement replac, adoption adopt, region region, angularity angular,
        rate rate, probate probat, cease ceas, controll control, roll roll, retained retain, retains retain,
        policies polici, policy polici, running run
    """
    pairs = dict(pair.split() for pair in published.split(","))
    pairs |= {"x1s": "x1s", "cafés": "cafés", "wörter": "wörter", "is": "is"}
    words = spark.createDataFrame([(word,) for word in pairs] + [(None,)], "term string")
    got = {r.term: r.stem for r in stems.stemmed(words).collect()}
    assert got == {**pairs, None: None}
