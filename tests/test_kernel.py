"""Text functions without Spark."""

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from sparkwarden.functions import checksums, kernel, patterns, pii
from sparkwarden.functions.registry import DEFAULT, FilterOptions, Registry

EN, BOTH = FilterOptions(), FilterOptions(languages=("en", "de"))


def found(text, options=EN):
    return [t for t, bad in kernel.segments(text, options) if bad]


def test_lists_are_whole():
    lists = patterns.builtin_lists()
    assert set(lists) == {"en", "de"} and all(len(x["block"]) >= 40 and len(x["allow"]) >= 40 for x in lists.values())
    for x in lists.values():
        assert all(len(set(stems)) == len(stems) for stems in x.values())
        for stem in (*x["block"], *x["allow"]):
            patterns.check(stem)
            patterns.check(patterns.expand(stem))


@pytest.mark.parametrize("text", ["Die Klasse misst Wasser in Massen und verpasst den Kompass.", "Der Kumpel analysiert das Dokument im Kanal.", "Schinken, Krapfen und ein dickflüssiger Saft.", "Homöopathie ist homogen.", "Das Publikum schwankt kunterbunt.", "Ein harscher Marsch, ein Barsch."])
def test_innocent_german(text):
    assert found(text, BOTH) == []


@pytest.mark.parametrize("text", ["The classic assistant assessed the glass.", "A cocktail in the cockpit with a peacock.", "Scunthorpe has a document on circumstances.", "A suspicious, spicy scrap.", "Coarse arsenic was parsed.", "Attach the debugger on Saturday.", "Swanky Fukuoka"])
def test_innocent_english(text):
    assert found(text, EN) == [] == found(text, BOTH)


@pytest.mark.parametrize("text,want", [("Du Dreckschwein, du Drecksack!", ["Dreckschwein", "Drecksack"]), ("So ein Arschloch", ["Arsch"]), ("verdammte Scheiße", ["verdammt", "Scheiß"]), ("du Schwein, du Schweinehund", ["Schwein", "Schweinehund"]), ("Hurensohn, Blödmann, Trottel", ["Hurensohn", "Blödmann", "Trottel"]), ("a wanker and a bitch", ["wank", "bitch"])])
def test_what_must_be_flagged(text, want):
    assert found(text, BOTH) == want


@pytest.mark.parametrize("text", ["", " ", "\n\t", "﻿"])
def test_blank_text_is_one_clean_piece(text):
    assert kernel.segments(text, EN) == [(text, False)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("what an asshole", ["ass"]), ("you @sshole", ["@ss"]), ("f u c k this", ["f u c k"]), ("fuuuuck", ["fuuuuck"]), ("sh⁠it", ["sh⁠it"]),
        ("Ａｓｓｈｏｌｅ", ["Ａｓｓ"]), ("shit shit", ["shit", "shit"]), ("shitshit", ["shit", "shit"]), ("a classic assessment", []), ("a cl4ssic mistake", []),
        ("Welcome to Scunthorpe", []), ("sh͓it", ["sh͓it"]), ("😀 shit", ["shit"]), ("x" * 3, []),
    ],
)
def test_disguises(text, want):
    assert found(text) == want


def test_case_folds_as_in_ecmascript():
    assert found("SCHEIẞE", BOTH) == ["SCHEIẞ"]
    own = FilterOptions(custom_list=("dick",), cross_check=False)
    assert found("dİck", own) == [] and found("dick DICK", own) == ["dick", "DICK"]


def test_whole_words_only():
    assert found("meine Hausaufgaben, ein Meerschweinchen", BOTH) == []
    assert found("du Sau", BOTH) == ["Sau"] and found("Straußschwanz", BOTH) == []


def test_options():
    assert found("class", FilterOptions(cross_check=False)) == ["ass"]
    assert found("darn shit", FilterOptions(custom_list=("darn",))) == ["darn"]
    assert found("shitake", FilterOptions(allow_list=("shitake",))) == []
    assert found("sh1t", FilterOptions(aggressive=False)) == []
    assert found("xay", FilterOptions(custom_list=("b*",))) == []
    with pytest.raises(LookupError, match="registered: en, de"):
        found("x", FilterOptions(languages=("fr",)))


def test_mask_counts_utf16_units():
    assert kernel.mask("what sh1t", EN) == "what ****"
    bold = "".join(chr(0x1D400 + ord(c) - 65) for c in "SHIT")
    assert kernel.mask(bold, EN, "#") == "#" * 8


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("as shiT.*@$1​̈ße😀ﬁＳı\n"), max_size=40))
def test_segments_are_lossless_and_quick_search_is_exact(text):
    pieces = kernel.segments(text, BOTH)
    assert "".join(t for t, _ in pieces) == text
    lists = BOTH.resolved()
    seen = (kernel.normalize(text) or (text,))[0]
    block = patterns.python_regex(lists.block, True)
    assert list(kernel._matches(block, patterns.quick_regex(lists.block, True), seen)) == list(kernel._matches(block, None, seen))


def slow_normalize(text):
    """Character by character."""
    import unicodedata

    import regex

    if not kernel.needs_rewrite(text):
        return None
    gaps = {i for m in kernel._RUN.finditer(text) for i in range(*m.span()) if kernel._GAP.match(text[i])}
    folded, i = [], 0
    mark = lambda c: unicodedata.category(c)[0] == "M"
    while i < len(text):
        if i in gaps or mark(text[i]) or unicodedata.category(text[i]) == "Cf":
            i += 1
            continue
        j = i + 1
        while j < len(text) and j not in gaps and mark(text[j]):
            j += 1
        kept = regex.sub(r"\p{M}", "", unicodedata.normalize("NFKC", text[i:j])) or text[i]
        folded += [(c, i, j) for c in kept]
        i = j
    out, i = [], 0
    while i < len(folded):
        j = i + 1
        while j < len(folded) and folded[j][0].lower() == folded[i][0].lower():
            j += 1
        out += [(folded[i][0], folded[i][1], folded[j - 1][2])] if j - i >= 3 else folded[i:j]
        i = j
    return "".join(c for c, *_ in out), [a for _, a, _ in out], [b for *_, b in out]


ODD = st.text(alphabet=st.sampled_from("aAbß. -_\n￼éｅ́̈ﬁΣσςİıKk​½Ⅷ가ᄀ각😀"), max_size=30)


@settings(max_examples=1500, deadline=None)
@example("A.A.A⅐")
@given(st.one_of(st.text(max_size=60), ODD))
def test_rewriting_places_is_rewriting_all(text):
    assert kernel.normalize(text) == slow_normalize(text)
    assert (kernel._THREE.search(text) is None) or kernel._TWO.search(text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("asctiäkf4@$3*#^<(oh0uSſKе ё"), max_size=25))
def test_the_finder_misses_no_match(text):
    for options in (BOTH, EN, FilterOptions(languages=("en", "de"), aggressive=False)):
        lists = options.resolved()
        block, quick, finder = patterns.python_regex(lists.block, options.aggressive), patterns.quick_regex(lists.block, options.aggressive), patterns.finder(lists.block, options.aggressive)
        assert finder is not None
        assert list(kernel._matches(block, quick, text, finder)) == list(kernel._matches(block, None, text))


def test_plain_stems_are_spelled_out():
    assert patterns.words_of("a(?:b|cd?)e") == ["abe", "acde", "ace"] and patterns.words_of("x+") is None and patterns.words_of("(?:ab)?") is None


def test_normalize_maps_back():
    text, starts, ends = kernel.normalize("a b c dd")
    assert text == "abc dd" and starts == [0, 2, 4, 5, 6, 7] and ends == [1, 3, 5, 6, 7, 8]
    assert kernel.normalize("plain") is None and kernel.normalize("aAa") is None
    assert kernel.normalize("zzz aAa")[0] == "z a" and kernel.normalize("x   y")[0] == "x y"


def test_registry():
    own = DEFAULT.register("de-AT", block=["oida"], extends="de")
    assert own.resolve("DE-at-x") == "de-at" and own.resolve("fr") is None and "en-GB" in own and "de-at" not in DEFAULT.codes()
    assert own.lists("de-at").block[-1] == "oida" and len(own.lists("de-at").block) == len(DEFAULT.lists("de").block) + 1
    with pytest.raises(LookupError):
        own.unregister("de")
    with pytest.raises(LookupError, match="cycle"):
        own.register("de", extends="de-at")
    with pytest.raises(LookupError):
        DEFAULT.register("x", extends="nope")
    with pytest.raises(TypeError):
        DEFAULT.register(" ")
    with pytest.raises(TypeError):
        DEFAULT.register("x", block=[""])
    assert own.unregister("de-at").codes() == ["en", "de"] and Registry().codes() == []


@pytest.mark.parametrize("bad", ["b\\-d", "[abc]", "(", "a)", "a{", "]", "*a", "[a", "(?<a>x)", "\\"])
def test_patterns_that_are_refused(bad):
    with pytest.raises(patterns.PatternError):
        DEFAULT.register("x", block=[bad])


@pytest.mark.parametrize("good", ["\\p{L}*x", "[^xyz]", "(?:b|d)+?", "(?<!x)y(?=z)", "\\$\\.", "b{2,3}", "[x-z\\-]"])
def test_patterns_that_are_taken(good):
    patterns.check(good)


def test_checksums():
    assert checksums.is_luhn("4111111111111111") and not checksums.is_luhn("4111111111111112") and not checksums.is_luhn("0") and not checksums.is_luhn("4a")
    assert checksums.is_iban("GB82 WEST 1234 5698 7654 32") and not checksums.is_iban("GB82WEST12345698765431") and not checksums.is_iban("XX82WEST12345698765432")
    assert len(checksums.IBAN_LENGTHS) == 79
    assert checksums.is_german_tax_id("86095742719") and not checksums.is_german_tax_id("86095742718") and not checksums.is_german_tax_id("06095742719") and not checksums.is_german_tax_id("11111111111")


@pytest.mark.parametrize(
    "text,want",
    [
        ("write lena.brandt@example.com.", [("email", "lena.brandt@example.com")]), ("call me on +1 202 5550123", [("phone", "+1 202 5550123")]), ("Tel. 030 12345678", [("phone", "030 12345678")]),
        ("IBAN GB82 WEST 1234 5698 7654 32 now", [("iban", "GB82 WEST 1234 5698 7654 32")]), ("card 4111 1111 1111 1111", [("card", "4111 1111 1111 1111")]),
        ("server 192.168.1.1 and 2001:db8::1", [("ip", "192.168.1.1"), ("ip", "2001:db8::1")]), ("version 1.2.3.4", []), ("on 12.05.2026", []), ("Steuer-ID 86095742719", [("taxid-de", "86095742719")]),
        ("reference 86095742719", []), ("1701234567", []), ("a@b", []), ("x..y@example.com", []), ("01:02:03", []), ("::ffff:1.2.3.4", [("ip", "::ffff:1.2.3.4")]), ("", []),
    ],
)
def test_findings(text, want):
    assert [(f.kind, f.text) for f in pii.detect(text)] == want


def test_finding_options():
    assert pii.detect("a@example.com", pii.PiiOptions(kinds=())) == []
    with pytest.raises(TypeError):
        pii.detect("", pii.PiiOptions(kinds=("name",)))
    assert pii.detect("1701234567", pii.PiiOptions(min_confidence=0.2))[0].confidence == 0.3
    assert [x[0] for x in pii.pii_segments("a b@example.com c", pii.detect("a b@example.com c"))] == ["a ", "b@example.com", " c"]


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 8), st.sampled_from([0.3, 0.6, 0.95])), max_size=8))
def test_best_set_is_the_heaviest(spans):
    all_of = [pii.Finding("ip", "", a, a + n, c, ()) for a, n, c in spans]
    got = pii.best_set(all_of)
    assert all(a.end <= b.start for a, b in zip(got, got[1:]))
    weight = lambda fs: sum(f.confidence * (f.end - f.start) for f in fs)

    def best(rest, at):
        return max([0.0] + [weight([f]) + best([g for g in rest if g.start >= f.end], f.end) for f in rest if f.start >= at])

    assert abs(weight(got) - best(all_of, 0)) < 1e-9
