"""Hand-written expectations for text, term and quality functions."""

import re

from pyspark.sql import functions as F

from lexispan.functions import evidence as E
from lexispan.functions import quality as Q
from lexispan.functions import similarity as S
from lexispan.functions import terms as T
from lexispan.functions import text as X
from lexispan.operators import mining
from lexispan.operators import nodes as N
from lexispan.operators import scopes as SC
from lexispan.operators import units as U


def rows(spark, values, fn, *more):
    data = [v if isinstance(v, tuple) else (v,) for v in values]
    cols = ["a", "b", "c", "d"][: len(data[0])]
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))
    return [r[0] for r in df.select(fn(*[F.col(c) for c in cols], *more)).collect()]


def test_normalising(spark):
    assert rows(spark, ["  Foo--Bar_baz  X "], X.normalize_source) == ["foo bar baz x"]
    assert rows(spark, ["Re-Entry\n Phase"], X.document_key) == ["re-entry phase"]
    got = rows(spark, ["Table 3. The Blue Line 42", "Figure  X", "(the Term)", "a", "Foo – Bar,"], X.clean_term)
    assert got == ["Blue Line", "X", "Term", "", "Foo - Bar"]


def test_word_edges(spark):
    pairs = [("NATOé joined", "NATO"), ("xNATO", "NATO"), ("a nato b", "NATO"), ("C++ code", "C++"), ("한국NATO", "NATO")]
    assert rows(spark, pairs, X.contains_term) == [True, False, True, True, False]
    assert rows(spark, [("foo foo foo", "foo"), ("the the the", "the the")], X.count_term) == [3, 1]


def test_acronyms(spark):
    assert rows(spark, ["NATO and IX and NATOé AB-c FOO- 1"], X.extract_acronyms) == [["NATO", "AB-", "FOO"]]
    assert rows(spark, ["iPhone", "Phone", "PHONE", "McDonald"], X.is_mixed_case) == [True, False, False, True]


def test_translatable(spark):
    lines = ["", " ", "=SUM(A1)", "$1,200.50", "https://x.y", "a@b.co", "n/a", "Hello", "３"]
    assert rows(spark, lines, X.is_translatable) == [False] * 6 + [True, True, False]


def test_shape_reasons(spark):
    terms = ["N/A", "Bank of", "Of Bank", "IX", "A B C D E F G H I", "Foo is Bar Baz Qux", "Blue Line"]
    assert rows(spark, terms, T.invalid_reason) == [
        "placeholder", "ends_with_function_word", "starts_with_function_word", "acronym_noise",
        "too_long_sentence_like_phrase", "sentence_pattern", "",
    ]
    assert rows(spark, ["Blue Line Blue", "Blue Line"], T.repeated_key_token) == [True, False]


def test_full_form_pairs(spark):
    df = spark.createDataFrame([("The World Health Organization (WHO) met.",)], "text string")
    units = df.selectExpr("1L doc_id", "0L unit_id", "text", "'paragraph' element_type", "false is_header")
    got = {r.normalized_source: r for r in mining.extract_candidates(units).collect()}
    assert got["who"].aliases == ["World Health Organization", "World Health Organization (WHO)"]
    assert got["world health organization"].aliases == ["WHO", "World Health Organization (WHO)"]


def test_korean_words(spark):
    df = spark.createDataFrame([("서버에서 보안을 검토합니다",)], "text string")
    got = df.select(F.flatten(mining.segment_words("text", True))).first()[0]
    assert got == ["서버", "보안", "검토"]


def test_target_candidates(spark):
    cases = [
        ("World Health Organization (WHO) rules", "세계보건기구 (WHO) 규칙", "WHO"),
        ("Server", "서버", "Server"),
        ("Server: a machine", "서버: 기계", "Server"),
        ("apples, pears and plums", "사과, 배 및 자두", "pears"),
        ("no pair here", "다른 문장", "pair"),
        ("same", "same", "same"),
    ]
    assert rows(spark, cases, T.target_candidate) == ["세계보건기구(WHO)", "서버", "서버", "배", None, None]


def test_target_shapes(spark):
    assert rows(spark, [("Server", "Server X"), ("Server", "서버"), ("NATO", "a b c d e f")], T.bad_target) == [True, False, True]
    assert rows(spark, [("A B C D", "x"), ("A B C", "x (ABC)"), ("A B C", "x"), ("NATO", "x")], T.too_short_target) == [
        True, False, True, False,
    ]


def test_ambiguous_acronym(one):
    def ask(aliases):
        return one({"t": "ABC", "a": aliases}, x=T.ambiguous_acronym("t", "a"))["x"]

    assert ask(["Alpha Beta", "Another Big Corp"]) is True
    assert ask(["Alpha Beta", "Alpha Beta Corp", "Alpha Beta (ABC)"]) is False


def test_storage_reasons(spark):
    cases = [("", "x", "ko"), ("[번역 실패] y", "x", "ko"), ("漢字", "x", "ko"), ("서버", "", "ko"), ("서버", "서버", "ko"), ("서버", "x", "en")]
    assert rows(spark, cases, T.storage_skip_reason) == [
        "empty_translation", "failed_translation_marker", "unexpected_script_in_translation", "no_target_candidate", "",
        "unexpected_script_in_translation",
    ]


def test_snippets(spark):
    long = "Intro text here. " + "The Server room is cold and quiet today. " + "Filler words go on. " * 20
    assert rows(spark, [(long, "Server")], E.short_snippet, 60) == ["The Server room is cold and quiet today."]
    assert rows(spark, [("  short   text ", "x")], E.short_snippet, 60) == ["short text"]
    run = "word " * 100 + "Server " + "word " * 100
    got = rows(spark, [(run, "Server")], E.short_snippet, 60)[0]
    assert "Server" in got and len(got) <= 70


def test_evidence_context(spark):
    ctx = "PREVIOUS: The old Server stood.\nNEXT: It was gone."
    assert rows(spark, [("and then fell", ctx, "Server")], E.evidence_context) == ["The old Server stood. It was gone."]
    assert rows(spark, [("It was gone.", ctx, "Server")], E.evidence_context) == ["The old Server stood. It was gone."]


def test_quality(spark):
    assert rows(spark, [("x", "PREVIOUS: x"), ("NEXT: a", "NEXT: b")], Q.label_leaked) == [True, False]
    cases = [("text", '{"a": 1}'), ("text", "bad �"), ("text", "ЖЖЖ"), ("text", "!!!###$$$"), ("text", "fine")]
    assert rows(spark, cases, Q.corrupted) == [True, True, True, True, False]
    assert rows(spark, [("He left.", "“Go,” he said"), ("“Go”", "“Geh”")], Q.structure_drift) == [True, False]
    assert rows(spark, ["!!!###$$$", "$12.50", "!!a!!##", "---------"], Q.symbol_junk) == [True, False, False, False]


def test_language_reasons(one):
    def ask(o, t, lang):
        return one({"o": o, "t": t}, x=Q.language_reasons("o", "t", F.lit(lang)))["x"]

    assert ask("a text", "문장 漢字", "ko") == ["unexpected_foreign_script=漢字"]
    assert ask("the whole phrase", "the whole phrase stays here untouched by anyone today", "ko")[0].startswith("untranslated_english_phrase=")
    assert ask("서버", "서버 server", "en") == ["hangul_remaining"]
    assert ask("서버", "서버", "ja") == ["hangul_remaining_without_japanese_kana"]
    assert ask("plain", "서버", "en") == []
    assert ask("plain", "NATO ISO-9001", "ko") == []


def test_formality(one):
    def ask(t, element="paragraph"):
        return one({"t": t}, x=Q.formality_broken("t", F.lit("ko"), F.lit("formal_hamnida"), F.lit(element)))["x"]

    assert ask("그는 갔다.") is True
    assert ask("그는 갔습니다.") is False
    assert ask("그는 갔다.", "heading") is False
    assert ask('"그는 갔다." 라고 말했습니다.') is False
    assert ask("그는 갔다. 그는 왔습니다") is False


def test_needs_translation(one):
    def ask(t, lang):
        return one({"t": t}, x=Q.needs_translation("t", F.lit(lang)))["x"]

    assert ask("한국어 문장입니다 NATO", "ko") is False
    assert ask("This is a long English sentence about nothing.", "ko") is True
    assert ask("漢字だけ", "ja") is False and ask("漢字", "ja") is True
    assert ask("123 !!", "xx") is False
    assert ask("x " * 12000 + "한국어", "en") is True


def test_similarity(spark):
    a, b = "the quick brown fox jumps over it", "the quick brown fox jumped over it"
    got = rows(spark, [(a, b), ("short", "short")], S.similarity)
    assert 0.9 < got[0] < 1 and got[1] == 0.0
    assert rows(spark, [("abcXdef", "zzcXdezz")], lambda x, y: S.longest_common(x, y, F.lit(True))) == [4]


def test_hints(one):
    got = one({"t": "Dep. only", "c": "Deposit Processing and Department"}, x=U.abbreviation_hints("t", "c"))["x"]
    assert got == "ABBREVIATION_HINTS: Dep. = Deposit"
    hint = one(
        {"t": "“Come,” Mary said to John", "c": "a teacher"},
        x=U.dialogue_hint("t", "c", F.lit("paragraph"), F.lit("docx")),
    )["x"]
    assert hint["speaker_candidate"] == "Mary" and hint["listener_candidate"] == "John"


def brute_hint(t, before):
    """Direct speech of a text by plain regular expressions: None, or speaker, listener and cues."""
    find = lambda p, s: re.search(re.sub(r"^\(\?(i?)U\)", lambda m: "(?i)" if m[1] else "", p), s or "")

    def person(*patterns):
        for p in patterns:
            m = find(p, t)
            name = re.sub(r"\s+(?:had|has|was|is)$", "", " ".join(m[1].split()).strip(" ,.:;\"'“”‘’")) if m else ""
            if name and name.lower() not in ("he", "she", "they", "it", "we", "i", "you"):
                return name[:80]

    if not any(find(p, t) for p in (U.STARTS_WITH_QUOTE, U.SPEAKER_BEFORE, U.SPEAKER_AFTER_QUOTE)):
        return None
    both = (before or "") + "\n" + (t or "")
    cues = [
        name for p, s, name in (
            (U.FAMILY_WORDS, both, "family_or_caregiver_child"), (U.PEER_WORDS, both, "peer_or_friend"),
            (U.INSTITUTION_WORDS, t, "institutional_or_ritualized"),
        ) if find(p, s)
    ]
    return person(U.SPEAKER_AFTER_QUOTE, U.SPEAKER_BEFORE), person(U.LISTENER), ", ".join(cues) or None


def test_dialogue_hints_of_every_row(spark):
    """No turn and no line is left out or changed."""
    from lexispan.checks.job_checks import line_hints, turn_hints
    from lexispan.operators.nodes import read_nodes

    texts = [
        "“Come here,” Mary said to John Smith.", "no names at all", '"Don\'t," she whispered to Ann', "'Tis late", "‘Yes,’ Mother replied",
        None, "", "Peter's friend asked the teacher to Paul", "We went to Rome.", "The ritual began", "“Only a quote”", "the old man had said so",
    ]
    turns = [(i % 2, i, t) for i, t in enumerate(texts)] + [(None, 3, texts[0]), (7, None, texts[2])]
    got = turn_hints(spark.createDataFrame(turns, "conv_id long, turn long, text string")).collect()
    want = []
    for c, n, t in turns:
        before = next((x for d, m, x in turns if c is not None and n is not None and (d, m) == (c, n - 2)), None)
        want.append((c, n, brute_hint(t, before)))
    read = lambda r: (r["speaker"], r["listener"], r["cues"]) if r["direct"] else None
    assert sorted(((r["conv_id"], r["turn"], read(r)) for r in got), key=repr) == sorted(want, key=repr)
    hints = {(c, n): h for c, n, h in want}
    assert hints[0, 0] == ("Mary", "John Smith", None) and hints[1, 1] is None and hints[0, 2][1] == "Ann" and hints[0, 4][0] == "Mother"
    docs = spark.createDataFrame([(5, "\n".join(t or "" for t in texts), "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    nodes = read_nodes(docs)
    kinds = {r["node_id"]: r for r in nodes.collect()}
    lines = {r["node_id"]: r for r in line_hints(nodes).collect()}
    assert len(lines) == len(kinds) and any(r["direct"] for r in lines.values())
    for n, r in kinds.items():
        before = kinds[n - 1]["text"] if n - 1 in kinds else None
        own = brute_hint(r["text"], before) if (r["element_type"] or "").strip() in ("paragraph", "list_item", "") else None
        assert read(lines[n]) == own, r["text"]


def test_cleanup(spark):
    assert rows(spark, ["NATO 는 서버 (ABC) 와"], X.cleanup_translation) == ["NATO는 서버(ABC)와"]


def test_scopes(spark):
    got = spark.createDataFrame(
        [(1, "pptx:slide:3", "", "", ""), (1, "", "sheet", "2", ""), (1, "", "sheet", "", "Data (4)"), (1, "docx:page:x", "", "", ""), (1, "", "", "", "")],
        "doc_id long, scope string, kind string, index string, name string",
    )
    out = {(r.scope_type, r.scope_number, r.scope_name, r.scope_error) for r in N.normalize_scopes(got).collect()}
    assert ("slide", 3, None, False) in out and ("sheet", 2, None, False) in out
    assert ("sheet", None, "Data", False) in out and ("document", None, None, False) in out
    assert ("batch", None, None, True) in out


def test_memory_text(spark):
    lines = ["Server: 서버", "Section 2: 개요", "use the translation X", "A -> B", "Plain text."]
    assert rows(spark, lines, SC.glossary_like) == [True, False, True, True, False]
    assert rows(spark, ["**Voice**", "Unknown"], SC.memory_label) == ["Style continuity", ""]


def test_json_recovery(spark):
    raw = ["noise [1, 2] tail", '{"a": 1}', "x {\"a\": 2} y", "nothing"]
    assert rows(spark, raw, SC.recover_json) == ["[1, 2]", '{"a": 1}', '{"a": 2}', None]


def test_split_text(spark):
    five = "w" * 500
    assert rows(spark, [five], U.split_text) == [[five]]
    sentences = ("This is a sentence of some length here. " * 30).strip()
    got = rows(spark, [sentences], U.split_text)[0]
    assert all(len(f) <= 800 for f in got) and " ".join(got).split() == sentences.split() and len(got) == 2
    solid = "word " * 200
    got = rows(spark, [solid], U.split_text)[0]
    assert all(len(f) <= 800 for f in got) and " ".join(got).split() == solid.split()
