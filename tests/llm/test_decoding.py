"""The digest of the decoded text comes from the ids of the whole document."""

import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from loomgraph.llm.pieces import Pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_digest_decodes_every_document(monkeypatch):
    model = Pieces(MODEL)
    text = "two words  and \n more"
    assert model.digest(text)[2] == hashlib.sha256(text.encode()).hexdigest()
    asked = []
    monkeypatch.setattr(model, "_bytes", lambda ids: asked.append(ids.tolist()) or b"what the ids say")
    assert model.digest(text)[2] == hashlib.sha256(b"what the ids say").hexdigest() and asked == [model.encode(text)]


def test_digest_of_ids_that_are_no_utf8(monkeypatch):
    """Ids of single bytes decode as the library has it."""
    model, library = Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(3, 259) if rng.random() < 0.7 else rng.randrange(259, 32000) for _ in range(rng.randint(1, 8))]
        monkeypatch.setattr(model, "parts", lambda _, ids=ids: [",".join(map(str, ids))])
        assert model.digest("x")[2] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert model.decode(np.array(ids)) == library.decode(ids)


def test_columns_that_clash(spark):
    from loomgraph.llm.pieces import encode

    rows = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, `__text` string, `a.b` string")
    for digest in (True, False):
        assert {"doc_id", "text", "__text", "a.b"} <= set(encode(rows, MODEL, digest=digest).first().asDict())


def test_marks_that_join_nothing():
    """Words are cut where no piece has two characters side by side; long runs of such, too."""
    model, library = Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(4)
    parts = ["a", "the", "e,", "§", "門", "龘", "\n", ".", "…", "ü", "x", "Ω"]
    texts = ["龘" * 5000, "§," * 3000, "," * 9000, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 50))) for _ in range(2000))]
    for text in texts:
        assert model.encode(text) == library.encode(text), text[:50]
