"""Personal data and secrets against the patterns as written."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import numpy as np
from llm_fixtures import documents, odd_texts

from lifetrace.llm import crf, pii, secrets

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_pii(text):
    out = []
    for k, (name, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True, "ip": name != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[name]
            if ok:
                out.append((k, *m.span()))
    return sorted(out)


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.A) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def mixed(rng, bits, n):
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(n)]


PII_BITS = ["a@b.c", "@", "x", ".", "1", "255", "256", "1.2.3.4", "..", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 555-1234", "+", " ", "(", ")", "-", "é", "@a.b", "a.b@c", "b.c@d.e", "0000000001", "1.1.1.1.1", "\n", "_", "%"]
SECRET_BITS = ["password", "PassWord", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEF123456", "xyz", "é", "ſecret", "0", "deadbeef", "\n", "-", "."]


def test_base_patterns_of_personal_data():
    for text in mixed(random.Random(20), PII_BITS, 20000):
        assert sorted(pii.base_spans(text)) == plain_pii(text), text


def test_direct_patterns_of_secrets():
    for text in mixed(random.Random(21), SECRET_BITS, 20000):
        assert secrets.direct(text) == plain_secrets(text), text


def test_long_texts_without_blanks_are_linear():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 100_000, "%41" * 50_000, "\\u0041" * 20_000):
        pii.find([text], pii_field())
        secrets.spans(text)


_FIELD = []


def pii_field():
    if not _FIELD:
        _FIELD.append(pii.trained())
    return _FIELD[0]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(22)
    field = crf.Field(rng.normal(size=(20, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = np.array([1, 4, 2, 3])
    features = rng.integers(0, 20, (int(lengths.sum()), 2))
    got, at = crf.viterbi(field, features, lengths), 0
    for n in lengths:
        scores = crf.emissions(field, features[at : at + n])

        def value(path):
            return field.start[path[0]] + sum(scores[i, s] for i, s in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))

        paths = [tuple(k // 3**i % 3 for i in range(n)) for k in range(3**n)]
        assert tuple(got[at : at + n]) == max(paths, key=value)
        at += n


def test_gradient_of_the_field():
    rng = np.random.default_rng(23)
    field = crf.Field(rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths, labels = np.array([3, 1, 2]), rng.integers(0, 3, 6)
    scores = rng.normal(size=(6, 3))
    _, steps = crf._packed(lengths)

    def loss(s, moves, start):
        total, at = 0.0, 0
        for n in lengths:
            v = s[at] + start
            for i in range(1, n):
                v = s[at + i] + np.logaddexp.reduce(v[:, None] + moves, axis=0)
            own = labels[at : at + n]
            total += np.logaddexp.reduce(v) - start[own[0]] - s[np.arange(at, at + n), own].sum() - moves[own[:-1], own[1:]].sum()
            at += n
        return total

    d_scores, d_moves, d_start = crf._gradient(field, scores, labels, steps)
    for got, which in ((d_scores, 0), (d_moves, 1), (d_start, 2)):
        for place in np.ndindex(got.shape):
            args = [scores.copy(), field.moves.copy(), field.start.copy()]
            args[which][place] += 1e-5
            up = loss(*args)
            args[which][place] -= 2e-5
            assert abs((up - loss(*args)) / 2e-5 - got[place]) < 1e-5


def test_field_on_held_out_rows():
    right = found = wanted = 0
    for text, spans in pii.labelled_table(seed=99, rows=300):
        words, lengths, rows = pii.runs(text)
        labels = crf.viterbi(pii_field(), np.array(rows), np.array(lengths)).tolist() if rows else []
        got = set(pii._entities(text, words, labels))
        right, found, wanted = right + len(got & set(spans)), found + len(got), wanted + len(spans)
    assert right / found > 0.95 and right / wanted > 0.95


def test_scan_of_personal_data(spark):
    texts = odd_texts(random.Random(24)) + mixed(random.Random(25), PII_BITS, 200) + ["call 555-123-4567 now", "no numbers here"]
    rows = {r.doc_id: r for r in pii.scan(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        base, row = plain_pii(text or ""), rows[i]
        written = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == j for k, *_ in base) for j in range(4)]
        assert row.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        spans = row.spans.split(",") if row.spans else []
        assert set(written) <= set(spans) and len(spans) == len(written) + row.n_added
    assert rows[len(texts) - 2].spans == "phone:5:17"
    assert rows[len(texts) - 1].spans == ""
    assert pii.scan(documents(spark, [])).count() == 0


SECRET = 'password = "abcdefghijkl1234"'


def layers():
    b64 = lambda b: base64.b64encode(b).decode()
    quote = lambda s: urllib.parse.quote(s, safe="")
    plain = SECRET.encode()
    return {
        "url": quote(SECRET), "url twice": quote(quote(SECRET)), "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET),
        "entities": "".join(f"&#{ord(c)};" for c in SECRET), "base64": b64(plain), "base64 twice": b64(b64(plain).encode()),
        "gzip": b64(gzip.compress(plain)), "zlib twice": b64(zlib.compress(zlib.compress(plain))),
        "all": quote(b64(zlib.compress(b64(plain).encode()))),
        "much": b64(zlib.compress(b" " * (3 * secrets.WINDOW) + plain)),
    }


def test_layers_are_unwrapped_and_mapped():
    for name, coded in layers().items():
        text = f"é before {coded} behind"
        base, more = secrets.spans(text)
        assert base == [], name
        assert any(kind == 0 for _, kind, _ in more), name
        for a, _, b in more:
            assert 9 <= a < b <= 9 + len(coded)
    # through escapes the span is that of the very signs
    base, more = secrets.spans("x " + urllib.parse.quote(f"a b {SECRET}", safe=""))
    (a, kind, b), = more
    assert urllib.parse.unquote(("x " + urllib.parse.quote(f"a b {SECRET}", safe=""))[a:b]) == SECRET[:-1]


def test_layers_that_repeat_end():
    text = "%25" * 50 + "41"
    assert secrets.spans(text) == ([], [])
    assert secrets.spans("%25252541 " * 20) == ([], [])


def test_scan_of_secrets(spark):
    texts = odd_texts(random.Random(26)) + mixed(random.Random(27), SECRET_BITS, 200) + [f"see {c}" for c in layers().values()]
    rows = {r.doc_id: r for r in secrets.scan(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        base, row = plain_secrets(text or ""), rows[i]
        written = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert row.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        spans = row.spans.split(",") if row.spans else []
        assert set(written) <= set(spans) and len(spans) == len(written) + row.n_inside
    assert all(rows[len(texts) - 1 - k].n_inside for k in range(len(layers())))
    assert secrets.scan(documents(spark, [])).count() == 0


def coded(data):
    return base64.b64encode(data).decode()


def inside(text):
    return {kind for _, kind, _ in secrets.spans(text)[1]}


def test_layers_with_signs_that_are_not_printable():
    plain = SECRET.encode()
    for odd in map(chr, (0xA0, 0x3000, 0xFEFF, 0x200B, 0x0C, 0x1B, 0)):
        assert inside(coded(odd.encode() + b" " + plain)) == {0}, odd
    assert inside(coded(b"\xff\xfe " + plain)) == {0}
    for k in range(3):  # windows that begin inside a sign
        much = b"x" * k + "中文 ".encode() * (3 * secrets.WINDOW // 7) + plain + "中文 ".encode() * (secrets.WINDOW // 7)
        assert inside(coded(zlib.compress(much))) == {0}


def test_a_run_over_the_end_of_a_window_is_whole(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 1000), monkeypatch.setattr(secrets, "OVERLAP", 50), monkeypatch.setattr(secrets, "STEP", 100)
    rng = random.Random(28)
    for at in range(0, 1000, 90):
        payload = coded(gzip.compress(rng.randbytes(2000) + b" " + SECRET.encode()))
        assert 0 in inside(coded(zlib.compress(b". " * (at // 2) + payload.encode() + b" ." * 2000)))


def test_windows_are_scanned_as_they_are_read(monkeypatch):
    reads, scans = [], []
    monkeypatch.setattr(secrets, "WINDOW", 1 << 16), monkeypatch.setattr(secrets, "OVERLAP", 1 << 10)
    windows, scan = secrets._windows, secrets._direct_inside
    monkeypatch.setattr(secrets, "_windows", lambda c: (reads.append(len(scans)) or w for w in windows(c)))
    monkeypatch.setattr(secrets, "_direct_inside", lambda t: scans.append(1) or scan(t))
    secrets.spans(coded(zlib.compress(b"".join(b"line %d of many\n" % i for i in range(50_000)))))
    assert reads[-1] > 5


def test_base64_over_several_lines():
    rng = random.Random(29)
    filler = "".join(rng.choice("ghijk .") for _ in range(400)).encode()
    packed = {"plain": lambda b: b, "gzip": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "zlib": zlib.compress}
    for name, pack in packed.items():
        for ahead in (0, 1, 2, 30):
            run = coded(pack(b"." * ahead + SECRET.encode() + filler + rng.randbytes(200)))
            for columns, end in ((64, "\n"), (76, "\r\n"), (57, "\n  ")):
                lines = end.join(run[i : i + columns] for i in range(0, len(run), columns))
                for text in (lines, f"-----BEGIN CERTIFICATE-----\n{lines}\n-----END", f"a_word_of_the_text\n{lines}\nof"):
                    assert 0 in inside(text), (name, ahead, columns)


def test_all_before_the_damage_is_scanned():
    rng = random.Random(30)
    for name, pack in (("gzip", gzip.compress), ("zlib", zlib.compress), ("xz", lzma.compress), ("bz2", bz2.compress)):
        whole = pack(SECRET.encode() + b" ")
        for behind in (b"\0" * 5, b"something else", whole[:6]):
            assert 0 in inside(coded(whole + behind)), (name, behind)
        other = pack(b"nothing in here, nothing ")
        if name != "zlib":
            assert 0 in inside(coded(other + whole)), name
    for pack in (gzip.compress, zlib.compress):
        # the end of the stream is lost, or overwritten
        whole = pack(SECRET.encode() + b" " + rng.randbytes(60_000))
        assert 0 in inside(coded(whole[:-20_000]))
        assert 0 in inside(coded(whole[:200] + b"\xff" * 50_000))
    # up to the very byte: a stored block whose last byte is that of the secret
    block = lambda data, last: bytes([last]) + len(data).to_bytes(2, "little") + (65535 - len(data)).to_bytes(2, "little") + data
    stream = b"\x78\x9c" + block(b". " * 500 + SECRET.encode(), 0) + b"\x06" + b"\xff" * 40
    assert 0 in inside(coded(stream))


def test_escapes_are_decoded_in_their_line():
    for text in ('token: "abc%2Bdefghijkl"', f"secret = {chr(92)}u0061bcdefghijklm", "password = &#97;bcdefghijklm", "%74oken : abcdefghijklm", r"é %C3%A9 token =  \x61bcd%65fghijklm"):
        base, more = secrets.spans(f"before\n{text}\nbehind")
        assert base == []
        start = min(k for k in (text.find("token"), text.find("%74"), text.find("secret"), text.find("password")) if k >= 0)
        assert any(a == 7 + start and kind == 0 and b >= 6 + len(text) for a, kind, b in more), text
    # a value that is too short hides no key that is a word of its own
    assert inside('secret= token:"abcdefghijkl%6D"') == {0}
    # deep escapes have no recursion
    assert 0 in inside("token = %" + "25" * 1500 + "61bcdefghijklm")
