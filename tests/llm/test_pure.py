"""What runs without Spark: readers, encoders, scanners and models, against brute-force versions."""

import base64
import hashlib
import io
import json
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quillgraph.llm import decontaminate, langid, neardup, quality, secrets, sharding, sstable, toxicity
from quillgraph.llm.text import ALNUM, Words, slices

TEXT = st.text(alphabet="aAbB 0:\n\té=|'.,́", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_the_patterns(texts):
    for letters, pattern in ((None, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = Words(pa.array(texts, pa.string()), *([letters] if letters is not None else []))
        for i, t in enumerate(texts):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
            own = [bytes(words.data[s:e]).lower().decode() for s, e in zip(words.start[words.first[i] : words.first[i + 1]], words.end[words.first[i] : words.first[i + 1]], strict=True)]
            assert own == re.findall(pattern, low)


def test_word_hash_ignores_place_and_case():
    w = Words(pa.array(["x Word", None, "", "word " + "y" * (1 << 21) + " WORD"]))
    assert w.hash[1] == w.hash[2] == w.hash[4] != w.hash[0]


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "text": ["x" * 50, None, "", "y" * 500, *"abcde"]})
    got = [i for s in slices([batch], rows=3, size=100) for i in s.column(0).to_pylist()]
    assert got == list(range(9))


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\0"), *(der(2, bytes([1] * 20)) for _ in range(8)))


def test_structural_spans_need_structure():
    key = base64.b64encode(RSA).decode()
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'someone'})}.c2lnbmF0dXJl"
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{key}\n-----END RSA PRIVATE KEY-----"
    kinds = lambda t: [k for *_, k in secrets.structural_spans(t)]
    assert kinds(f"a {key} b") == ["key"] and kinds(f"a {RSA.hex()} b") == ["key"]
    assert kinds(f"see {jwt} there") == ["jwt"] and kinds(pem) == ["pem"]
    assert kinds(base64.b64encode(f"config: {jwt}".encode()).decode()) == ["nested"]
    assert kinds(f"key={key}") == ["key"] and kinds(pem.replace("\n", "\\n")) == ["pem"] and kinds(pem[:-9] + pem) == ["key", "pem"][::-1]
    assert not kinds(key[:-8]) and not kinds("A" * 64) and not kinds(jwt.replace("eyJ", "eyK")) and not kinds("x" * 100_000)
    assert not secrets.is_key(RSA + b"\0") and not secrets.is_key(b"") and not secrets.is_key(b"\x30\x84")


def test_structural_spans_of_other_shapes():
    key = base64.b64encode(RSA).decode()
    url = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    kinds = lambda t: [(k, t[s:e]) for s, e, k in secrets.structural_spans(t)]
    for head in ('{ "alg": "HS256"}', '{\n"alg":"HS256"}', ' {"alg":"none"}'):
        token = f"{url(head)}.{url('{}')}.c2ln"
        assert kinds(f"a {token} b") == [("jwt", token)]
    sealed = f"{url('{\"alg\":\"dir\",\"enc\":\"A128GCM\"}')}..aXZpdg.Y2lwaGVy.dGFn"
    assert kinds(f"({sealed})") == [("jwt", sealed)] and not kinds(sealed.rsplit(".", 1)[0])
    for width in (32, 40, 64):
        for sep in ("\n", "\r\n", "\n  "):
            text = sep.join(key[i : i + width] for i in range(0, len(key), width))
            assert kinds(f"x {text}\nend of it") == [("key", text)], (width, sep)
    assert not kinds("\n".join(["a" * 64] * 9)) and not kinds("\n".join(key[i : i + 64] for i in range(0, 128, 64)))
    assert kinds("M" * 40 + f"\n{key[:64]}\n{key[64:128]}\n{key[128:192]}\n{key[192:]}")[0][0] == "key"
    text = key
    for _ in range(9):
        text = base64.b64encode(f"x={text}".encode()).decode()
    assert kinds(text) == [("nested", text)] and kinds(text.encode().hex()) == [("nested", text.encode().hex())]
    long = "y " * 300_000 + key + " " + "z" * 500_000
    assert kinds(long) == [("key", key)] and secrets.scan_text(long)[4] == f"key:600000:{600000 + len(key)}"


_PARTS = st.sampled_from(["password", "PassWD", "api_key", "APIKEY", "token", "secret", ":", "=", '"', "'", " ", "  ", "abcdef", "abc", "AKIA", "AKIA" + "Z9" * 8, "0a" * 12, "f" * 23, "é", "ſecret", "\n", "==", "-._", "A"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_PARTS, max_size=12).map("".join))
def test_base_spans_are_those_of_the_contract(text):
    want = []
    for kind, pattern, least in (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        ("access", r"()(AKIA[A-Z0-9]+)", 20),
        ("hex", r"()([0-9a-f]+)", 24),
    ):
        want += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m[2]) >= least]
    assert sorted(secrets.base_spans(text)) == sorted(want)
    joined = ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(want, key=lambda x: (x[0], ("assign", "access", "hex").index(x[2]))))
    assert secrets.scan_text(text)[3] == hashlib.sha256(joined.encode()).hexdigest()


def test_base_spans_drop_failing_matches():
    assert secrets.base_spans("token=token: abcdefgh") == []  # the short match takes the second keyword with it
    text = 'API_KEY = "abcdef" AKIA' + "A" * 16 + " " + "0" * 24 + " é paſſword: abcdef"
    assert [k for *_, k in sorted(secrets.base_spans(text))] == ["assign", "access", "hex"]
    assert secrets.scan_text(None) == secrets.scan_text("") == (0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)


VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aBcéÉ́İΣσ .,'s0 \n\t H̱<|ßﬁx—", max_size=30))
def test_remembered_pieces_give_the_library_s_ids(text):
    encoder = _encoder()
    (got,) = encoder.encode([text])
    assert np.frombuffer(got, "<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def _encoder(held=[]):  # noqa: B006
    if not held:
        held.append(sstable.Encoder(VOCABULARY, limit=50))
    return held[0]


def test_special_token_strings_are_encoded_as_the_library_does():
    for text in ("<|endoftext|> x", "a<|startoftext|>b", "<|ENDOFTEXT|>", "it's, .I'M ok. End."):
        assert np.frombuffer(_encoder().encode([text])[0], "<u2").tolist() == _encoder().tokenizer.encode(text, add_special_tokens=False).ids


def test_sstable_round_trip_and_lookup(monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 64)
    keys = [None, None, -5, 0, 1, 1, 2**62]
    out = io.BytesIO()
    writer = sstable.Writer(out)
    for i, k in enumerate(keys):
        writer.add(sstable.key_of(k), np.arange(i * 7, dtype="<u2").tobytes())
    writer.close()
    table = sstable.Table(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert [(sstable.id_of(k), v.tolist()) for k, v in table] == [(k, list(range(i * 7))) for i, k in enumerate(keys)]
    assert [len(x) for x in table.get(1)] == [28, 35] and [len(x) for x in table.get(None)] == [0, 7] and table.get(3) == []
    assert len(table.index) > 2 and table.docs == 7
    with pytest.raises(ValueError):
        writer.add(sstable.key_of(5), b"")


def test_matrix_has_exact_sums_and_uniform_cells():
    counts = np.array([3, 0, 5, 7])
    sizes, first = sharding.block_sizes(15, 4, 2)
    assert sizes.sum() == 15 and max(sizes.reshape(4, -1).sum(1)) - min(sizes.reshape(4, -1).sum(1)) <= 1 and first[0] == 0
    seen = np.zeros(len(sizes))
    for seed in range(300):
        m = np.array([sharding.matrix_row(counts, sizes, i, seed) for i in range(4)])
        assert (m.sum(1) == counts).all() and (m.sum(0) == sizes).all()
        seen += m[2]
    assert np.abs(seen / 300 - 5 * sizes / 15).max() < 0.15
    assert sharding.block_sizes(0, 24)[0].sum() == 0


def test_linked_gives_a_spanning_forest():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1000, 40)
    sets = [np.unique(np.where(rng.random(40) < 0.06, rng.integers(1000, 2000, 40), base if i % 3 else base + 5000)) for i in range(60)]
    label = list(range(60))
    for i, j in neardup.linked(sets, 80):
        a, b = label[i], label[j]
        assert a != b
        label = [a if x == b else x for x in label]
    want = list(range(60))
    for i in range(60):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n) and want[i] != want[j]:
                want = [want[j] if x == want[i] else x for x in want]
    assert len({(a, b) for a, b in zip(label, want, strict=True)}) == len(set(label)) == len(set(want))
    assert neardup.linked([], 80) == []


class Held:
    def __init__(self, value):
        self.value = value


def brute_windows(docs, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(name)
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for p in range(len(w)):
            for x, names in windows.items():
                if tuple(w[p : p + len(x)]) == x:
                    hit |= set(range(p, p + len(x)))
                    found |= names
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@settings(max_examples=60, deadline=None)
@example([], ["", "a a a"])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab c.", max_size=40)), max_size=5), st.lists(st.text(alphabet="ab c", max_size=16), max_size=4))
def test_decontamination_matches_brute_force(docs, texts):
    items = [(str(i % 3), t) for i, t in enumerate(texts)]
    blocks = [Held(decontaminate.Block(items[i : i + 2], 3)) for i in range(0, len(items), 2)]
    got = decontaminate.judge(pa.array(docs, pa.string()), blocks, 3)
    assert [x[:5] for x in got] == brute_windows(docs, items, 3)


def test_longest_match_and_its_place():
    item = " ".join(f"w{i}" for i in range(30))
    doc = "x y " + " ".join(f"w{i}" for i in range(5, 25)) + " z"
    ((*_, n, name, at, gone),) = decontaminate.judge(pa.array([doc]), [Held(decontaminate.Block([("7", item)], 13))])
    assert (n, name, at, gone) == (20, "7", 2, True)


def test_one_whole_window_removes_a_long_document_and_a_short_item_does_not():
    item = " ".join(f"w{i}" for i in range(40))
    filler = " ".join(f"f{i}" for i in range(2000))
    texts = [f"{filler} {' '.join(item.split()[7:20])} {filler}", f"{filler} {' '.join(item.split()[7:19])} {filler}", f"{filler} short item {filler}", "a short item b", None, ""]
    got = decontaminate.judge(pa.array(texts), [Held(decontaminate.Block([("7", item), ("8", "short item")], 13))])
    assert [x[-1] for x in got] == [True, False, False, True, False, False]
    assert [x[4] for x in got] == [False, False, False, True, False, False] and [x[1] for x in got] == [13, 0, 2, 2, 0, 0]


def test_languages_are_told_apart_and_parses_are_greedy():
    model = langid.Model({"x": b"abcabcabdabc " * 20, "y": b"mnopmnoqmno " * 20})
    lang, score = model.predict(pa.array(["abc abd", "mno", None, "", "é"]), np.array([True, True, False, False, True]))
    assert lang[:4] == ["x", "y", "und", "und"] and (score >= 0).all() and (score <= 1).all() and score[2] == 0
    move = langid.suffix_automaton([1, 2, 1, 1])
    walks = lambda w: all((s := move[s].get(c, -1)) >= 0 for c in w) if (s := 0) == 0 else False
    assert walks([2, 1, 1]) and walks([1, 1]) and not walks([2, 2])
    assert langid.Model({}).predict(pa.array(["a"]), np.array([True]))[0] == ["und"]


def brute_phrases(sample: bytes, text: bytes) -> int:
    """Greedy longest matches of ``text`` in ``sample``, both as classes."""
    n = i = 0
    while i < len(text):
        size = 1
        if text[i : i + 1] in sample:
            while i + size < len(text) and text[i : i + size + 1] in sample:
                size += 1
        i, n = i + size, n + 1
    return n


@settings(max_examples=40, deadline=None)
@example(["ab" * 900, "é" * 700], "abab" * 200, 8)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abcé. Z", max_size=90)), max_size=6), st.text(alphabet="abcé. ", min_size=1, max_size=60), st.integers(2, 16))
def test_phrases_are_those_of_whole_texts(texts, sample, stretch):
    old = langid.STRETCH, langid.LEAD
    langid.STRETCH, langid.LEAD = stretch, 2
    try:
        model = langid.Model({"x": sample.encode(), "y": b"bca ab"})
        got = model.costs(pa.array(texts, pa.string()))
    finally:
        langid.STRETCH, langid.LEAD = old
    classes = lambda b: model.classes[np.frombuffer(b, np.uint8)].astype(np.uint8).tobytes()
    for j, one in enumerate((sample.encode(), b"bca ab")):
        for i, t in enumerate(texts):
            assert got[i, j] == pytest.approx(brute_phrases(classes(one), classes((t or "").encode())) * model.weights[j])


def test_ties_go_to_the_first_language_and_long_texts_are_parsed_whole():
    model = langid.Model({"b": b"abcd " * 9, "a": b"abcd " * 9})
    lang, score = model.predict(pa.array(["abcd abc", "abcd " * 200_000]), np.array([True, True]))
    assert lang == ["a", "a"] and score.tolist() == [0, 0]


def test_nnpu_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    toxic = rng.random(900) < 0.3
    rows = [np.array([0, 2 + i % 5] if t else [1, 2 + i % 5]) for i, t in enumerate(toxic)]
    seen = [np.array([0, 2 + i % 5]) for i in range(200)]
    w, b = toxicity.nnpu(seen + rows, np.array([True] * 200 + [False] * 900), 7, 0.3)
    scores = [1 / (1 + np.exp(-(w[r].sum() + b))) for r in rows]
    assert np.mean([(s > 0.5) == t for s, t in zip(scores, toxic, strict=True)]) > 0.97
    assert toxicity.nnpu([], np.zeros(0, bool), 3, 0.1)[0].tolist() == [0, 0, 0]


def test_rule_base_is_the_contract_s():
    assert [r.name for r in quality.RULES if r.name in quality.BASE] == ["short", "repeats"]
