import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st

from scoutline.llm.pii import KINDS, emails, identifiers, joined, luhn, mask_pii, masked, may_spell, pii_spans, spans, spelled

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute(t):
    """The stated patterns, straight."""
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15],
    }


@given(st.text(alphabet="ab@.+-1234567890 ()é%\n", max_size=60))
def test_base_as_stated(t):
    assert identifiers(t) == brute(t)


def test_long_texts_take_linear_time():
    t = "a" * 300_000 + "@" + "1." * 100_000 + "9" * 200_000 + "+1" + "(" * 100_000
    assert emails(t) == [(0, m.end()) if (m := EMAIL.match(t)) else (0, 0)]
    identifiers(t)


def only(text):
    base, added = spans(text)
    assert not any(base.values())
    return [(k, text[a:b]) for k in KINDS for a, b in added[k]]


def test_disguises_map_back_to_their_source():
    assert only("mail john.doe (at) example [dot] com now") == [("email", "john.doe (at) example [dot] com")]
    assert only("jane at example dot org") == [("email", "jane at example dot org")]
    assert only("x jаne@exаmple.cоm y") == [("email", "jаne@exаmple.cоm")]
    assert only("ip １９２.168.0.1!") == [("ip", "１９２.168.0.1")]
    assert only("ip 10 [dot] 0 [dot] 0 [dot] 7") == [("ip", "10 [dot] 0 [dot] 0 [dot] 7")]
    assert only("call plus one two one two five five five zero one nine nine ok") == [("phone", "plus one two one two five five five zero one nine nine")]
    assert only("call five five five one two three four") == [("phone", "five five five one two three four")]
    assert only("card four one one one one one one one one one one one one one one one") == [("card", "four one one one one one one one one one one one one one one one")]



def test_plain_prose_is_left_alone():
    for t in ("meet at noon", "one two three", "look (at) this", "le café à 10 h", "Größe: 5", ""):
        assert only(t) == []


def test_base_stays():
    base, added = spans("a@b.co and c (at) d (dot) org")
    assert joined(base) == "email:0:6"
    assert added["email"] == [(11, 29)]
    assert masked("a@b.co and c (at) d (dot) org!") == "[EMAIL] and [EMAIL]!"


def test_query_rows(spark):
    rows = [(1, None, 4), (1, "é a@b.co 1.2.3.4 1.2.3.999 +1 (988) 555-2485", 5), (None, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {(r.doc_id, r.spans): r for r in pii_spans(df).collect()}
    assert set(got) == {(1, ""), (None, ""), (1, "email:2:8,ip:9:16,phone:27:44")}
    assert got[1, ""].base_sha256 == hashlib.sha256(b"").hexdigest()
    r = got[1, "email:2:8,ip:9:16,phone:27:44"]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added) == (1, 1, 0, 1, 0)
    assert pii_spans(df.limit(0)).collect() == []
    assert [r.text for r in mask_pii(df).collect()] == [None, "é [EMAIL] [IP] 1.2.3.999 [PHONE]", ""]


def test_disguise_in_part_of_an_identifier():
    for t, plain_rest in (("jоhn@example.com", (2, 16)), ("bob@mail.exаmple.com", (0, 11)), ("ann@mail.example [dot] org", (0, 16))):
        base, added = spans(f"{t}")
        assert base["email"] == [plain_rest]
        assert added == {k: [(0, len(t))] if k == "email" else [] for k in KINDS}
        assert masked(f"to {t} now") == "to [EMAIL] now"
    # What is found plainly already is not added, and no letter of an overlap is left.
    assert not any(spans("a@b.co – c")[1].values())
    assert masked("ring +1 (988) 555-248５!") == "ring [PHONE]!"


def test_every_disguise_alone_opens_the_gate():
    assert only("write to alice at example.com") == [("email", "alice at example.com")]
    assert only("write to alice at 3com.example dot org") == [("email", "alice at 3com.example dot org")]
    assert only("mail john[@]example[.]com now") == [("email", "john[@]example[.]com")]
    assert only("ip 192 dot 168 dot 1 dot 1") == [("ip", "192 dot 168 dot 1 dot 1")]
    assert only("ip one nine two dot one six eight dot one dot one") == [("ip", "one nine two dot one six eight dot one dot one")]
    assert only("ip 10 dot zero dot 0 dot 7") == [("ip", "10 dot zero dot 0 dot 7")]
    assert only("call 555 one two three 4, ok") == [("phone", "555 one two three 4")]
    assert only("call five five five dot one two three four") == [("phone", "five five five dot one two three four")]
    assert only("card 4111 one one one one 1111 one one one one") == [("card", "4111 one one one one 1111 one one one one")]
    for t in ("three dot five", "one or two of 2000000", "at 10 dot 30", "look at this. one two three 4 5", "f(.) and a [@] b", "1 2 3 4 5 6 7 8"):
        assert only(t) == []


def test_four_languages():
    for t in ("hans (ät) beispiel (punkt) de", "ana arroba ejemplo punto es", "luc arobase exemple point fr", "eva [arroba] ejemplo.es"):
        assert only(f"x: {t}, y") in ([("email", t)], [("email", t.removeprefix("x: "))]), t
    for t in ("null eins sieben zwei fünf fünf sechs neun", "seis cero uno dos tres cuatro cinco seis", "zéro un deux trois quatre cinq sept huit", "plus vier neun drei null acht neun eins"):
        assert only(f"ruf {t}!") == [("phone", t)], t
    assert only("ip eins neun zwei punkt eins sechs acht punkt null punkt eins") == [("ip", "eins neun zwei punkt eins sechs acht punkt null punkt eins")]
    for t in ("un deux trois, soleil", "le point de vue", "der Punkt ist", "dos o tres al punto", "neuf cents point"):
        assert only(t) == [], t


PIECES = ["jоhn@example.com", "write to alice at example.com", "a@b.co", "10 [dot] 0 [dot] 0 [dot] 7", "call 555 one two three 4", "plain words", "j\u200bohn@ex.com", "+1 (988) 555-2485", "é – ü", "dos punto com"]


@given(st.lists(st.sampled_from(PIECES), max_size=3), st.lists(st.sampled_from(PIECES), max_size=3))
def test_what_follows_does_not_change_what_is_found(before, after):
    text, more = " | ".join(before) + " ;\n; ", " | ".join(after)
    alone, both = spans(text), spans(text + more)
    for own, whole in zip(alone, both, strict=True):
        assert own == {k: [x for x in whole[k] if x[1] <= len(text)] for k in KINDS}


def test_an_invisible_character_does_not_leave_a_rest():
    assert masked("to j\u200bohn@ex.com now") == "to [EMAIL] now"


@given(st.lists(st.sampled_from(["five", "FIVE", "un", "dos", "acht", "fiveone", "5one", "555", "10", "zero", "plus", "x", "unix"]), max_size=14), st.sampled_from([" ", "-", ".", "  ", ", "]))
def test_the_cheap_test_misses_no_run(words, by):
    text = by.join(words)
    assert may_spell(text) or next(spelled(text), None) is None
