import random

import pytest

from driftline.llm.pieces import Coder, decode_ids, encode_texts, load_model

PATH = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def coder():
    return Coder(load_model(PATH))


def unigram_twin(model):
    """The same pieces with the model's scores, read by the library as a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    for piece, score in zip(proto.pieces, model.scores.tolist()):
        piece.score = score
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def texts():
    rng = random.Random(5)
    words = "the thanedble Éauouon überlich ñorar 漢字 日本 \U0001f600 a an ab x1 <s> 100 foo_bar ... \u0001 ﷺ".split()
    out = ["", " ", "  two  spaces ", "line\nbreak\n\n", "tab\tx", "aaaa" * 60, "x" * 300 + " é" * 50]
    return out + ["".join(rng.choice(words) + rng.choice([" ", "", "  ", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(60)]


def test_matches_the_library_as_unigram(coder):
    """The library adds scores in single precision: where it differs, it may not be better by more than that."""
    twin, scores, same = unigram_twin(coder.model), coder.model.scores, 0
    for text in texts():
        ours, theirs = coder.encode([text])[0], twin.encode(text)
        assert coder.decode(ours) == text
        same += ours == theirs
        assert sum(scores[i] for i in ours if coder.model.kinds[i] == "normal") >= sum(scores[i] for i in theirs if coder.model.kinds[i] == "normal") - 1e-3
    assert same >= 0.95 * len(texts())


def test_long_and_short_walks_agree(coder):
    for text in texts():
        words = coder.stretch.findall("▁" + text.replace(" ", "▁")) if text else []
        for word in words:
            if len(word) <= 96:
                coder.encode([text])
                assert coder.cache[word] == coder._alone(word)


def test_round_trip_on_spark(spark):
    model = load_model(PATH)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, None), (3, "again"), (3, "again"), (9, "a▁b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as ids", "2 as n_ids")
    encoded = encode_texts(docs, model)
    got = encoded.collect()
    assert len(got) == len(rows)
    assert all(r.round_trip for r in got if r.doc_id != 9 or r.ids != got[-1].ids)
    back = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in decode_ids(encoded, model).collect())
    assert back == sorted((i if i is not None else -1, (t or "").replace("▁", " ")) for i, t in rows)
    assert encode_texts(docs.limit(0), model).count() == 0
