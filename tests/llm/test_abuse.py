"""Scores of abusive, hateful and sexual texts."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import abuse
from tickloom.llm import lexicon as L

ABUSIVE = [
    "You are such an idiot, brask.", "only a u s e l e s s m o r o n like you would do it", "you pathetic l.o.s.e.r", "What a brainless little pаrаsite you are",  # Cyrillic a
    "shut your mouth, you 1d1o7", "you b*****d", "Du bist ein dummer Trottel", "Eres un imbécil inútil", "Va te faire foutre", "you stu​pid mo​ron",
    "I know where you live, watch your back.", "i will smash your teeth in", "Those foreigners are vermin and should be kept out",
    "send me nudes, I want to see your tits", "YOU ARE NOTHING BUT A RETARDDDDD", "you cretn",
]
HARMLESS = [
    "", "   ", "The batch was late and the clock drifted.", "I was an idiot to trust the default.", "The fixture should be idiot-proof.", "Shit, the queue is full again.",
    "Kill the orphaned child process, then abort.", "The master dies when both slaves lose quorum.", "Pest control found vermin under line 4.", "Women's network meets on the third floor.",
    "Immigrants on our team get help with forms.", "Our policy forbids harassment, hateful remarks and sexual content.", "strip the header, expose the naked pointer", "a pathetic design",
    "Rats chewed the cable.", "Das Fördersystem stand still.", "La version 0.6 réduit l'usage mémoire de 58 pour cent.",
]


@pytest.mark.parametrize("text", ABUSIVE)
def test_abusive(text):
    assert max(abuse.score_text(text).values()) >= abuse.THRESHOLD


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless(text):
    assert max(abuse.score_text(text).values()) < abuse.THRESHOLD


def distance(a, b):
    """Edits between two words, a swap of neighbours being one."""
    rows = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 3))
def test_automaton_counts_edits(a, b, errors):
    automaton = abuse.Automaton(list(a), errors)
    state = automaton.start()
    for c in b:
        state = automaton.step(state, c)
        if state is None:
            break
    d = distance(a, b)
    assert (automaton.cost(state) if state else None) == (d if d <= errors else None)


def test_rows_and_rates(spark):
    rows = [(1, "You idiot, brask.", "a"), (2, None, "a"), (3, "", None), (1, "You idiot, brask.", "a"), (4, "fine " * 20_000 + "\nyou are a worthless clown", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = abuse.scores(df, "doc_id", "text")
    assert got.columns == ["doc_id", "score", "insult", "threat", "hate", "sexual", "learned"]
    assert sorted((r["doc_id"], r["score"] >= 0.5) for r in got.collect()) == [(1, True), (1, True), (2, False), (3, False), (4, True)]
    rates = {r["source"]: (r["n_docs"], r["n_flagged"]) for r in abuse.rates(df, "doc_id", "text", "source").collect()}
    assert rates == {"a": (3, 2), None: (1, 0), "b": (1, 1)}
    assert abuse.scores(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/labels.parquet"), reason="no test tables here")
def test_agreement_with_reviewers_on_documents_not_learned_from(spark):
    d = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    mine = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    weights = abuse.weights_of(documents, labels.where(mine), "doc_id", "text", "abusive")
    marks = labels.where(~mine & F.col("abusive").isNotNull()).groupBy("doc_id").agg(F.avg("abusive").alias("y")).where("y <> 0.5")
    scored = abuse.scores(documents.join(F.broadcast(marks), "doc_id", "left_semi"), "doc_id", "text", weights).join(marks, "doc_id").collect()
    agree = sum((r["score"] >= abuse.THRESHOLD) == (r["y"] > 0.5) for r in scored)
    assert agree >= 0.93 * len(scored)


@pytest.mark.parametrize("text", ["the query took 47 seconds ***", "password: ******", "*** done ***", "fatal arts star form"])
def test_signs_are_no_masked_words(text):
    assert max(abuse.score_text(text).values()) < abuse.THRESHOLD


def test_garbled_encoding_and_swapped_letters():
    assert abuse.score_text("Ich weiß, wo dein Auto steht".encode().decode("cp1252"))["threat"] >= abuse.THRESHOLD
    assert abuse.score_text("touch it again and i iwll break every finger you have")["threat"] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", [
    "You worthless idiot, you should be banned.", "I will kill you, the police will never find out.", "You pathetic moron, the pipe is insulated.",
    "You \"worthless idiot\", get banned.", "Our policy is on the wiki, but as I told all of you there is nothing to discuss, you worthless idiot.",
])
def test_words_of_moderation_do_not_excuse_what_is_said(text):
    assert max(abuse.score_text(text).values()) >= 0.8


@pytest.mark.parametrize("text", [
    'He was banned for "you idiot" in the chat.', "Insults such as “you are a moron” get removed.", "The slur 'you pathetic loser' was removed.",
    "She was banned for calling him a worthless idiot.", 'The policy forbids "I know where you live" and the like.',
])
def test_quoted_and_reported_terms_count_less(text):
    assert 0 < max(abuse.score_text(text).values()) < abuse.THRESHOLD


@pytest.mark.parametrize("word", ["idiott", "cretn", "wrthless fool"])
def test_a_frequent_disguise_is_found_in_every_text(spark, word):
    df = spark.createDataFrame([(i, f"you {word}, run {i}") for i in range(60)], "doc_id bigint, text string")
    assert abuse.scores(df, "doc_id", "text").where(f"score >= {abuse.THRESHOLD}").count() == 60


@pytest.mark.parametrize("text", [
    "you may see a crash of your run", "a nice summer, you said", "Die Nummer, die du suchst", "tu peux baisser le volume", "you invest hours, the reaches are yours",
])
def test_common_words_near_listed_ones_are_harmless_by_themselves(text):
    assert max(abuse.score_text(text).values()) < abuse.THRESHOLD


@pytest.mark.parametrize("text", [
    "you idiooooooooooooooooooooooot", "you moronnnnnnnnnnnnnnnnnnnnnnn", "you m0000000000000000000000000ron", "you a$$$$$$$$$$$$$$$$$$$$$$$$hole", "you b*****ddddddddddddddddddddddd",
])
def test_stretched_words_of_any_length(text):
    assert max(abuse.score_text(text).values()) >= abuse.THRESHOLD


def test_long_words_stay():
    assert max(abuse.score_text(f"you {'donaudampfschifffahrtsgesellschaft' * 3} " + "x" * 50_000).values()) == 0


@pytest.mark.parametrize("text", [
    "The Roma are parasites.", "Poles are subhuman", "trans people are vermin", "Die Polen sind alle Abschaum.", "Los gitanos son unas ratas.", "Les Roms sont de la vermine.",
    "Nobody would even miss you.", "Filthy animals, all of them.",
])
def test_demeaning_of_any_group(text):
    assert max(abuse.score_text(text).values()) >= abuse.THRESHOLD


@pytest.mark.parametrize("text", [
    "Ticks are parasites.", "Our flaky tests are a plague.", "The Roma are not vermin.", "There are rats in the hall.", "Los datos son basura.", "Mice and rats are vermin.",
    "Nobody hits the stop button of the idle line.", "This is how a good team dies: no reviews.",
])
def test_animals_and_things_are_no_groups(text):
    assert max(abuse.score_text(text).values()) < abuse.THRESHOLD


def test_no_invented_group_is_listed():
    assert not {"velmari", "tashkor", "kadruvian", "ostrene", "velmaren", "kadruvios", "ostrenes"} & set(abuse._lexicon().parts)


def taught(spark, n=100, **options):
    """Weights from a made-up sample: nobody's lexicon holds what is abusive in it, and every tenth mark is missing or wrong."""
    rng = random.Random(3)
    plain = "the quokka sorted seven lamps before noon|a lamp near the window was green|who sorted the lamps again|green lamps are kept in the shed".split("|")
    documents, labels = [], []
    for i in range(n * 5):
        bad = i % 5 == 0
        lines = rng.sample(plain, 2) + ([rng.choice(["you are a right old zibbledorf", "what a zibbledorf he is", "go back under the snurk", "zibbledorf that you are", "get lost, zibbledorf", "no zibbledorf may stay", "that zibbledorf sleeps", "under the snurk with you"])] if bad else [])
        rng.shuffle(lines)
        documents.append((i, ". ".join(lines), "a"))
        labels.append((i, "r1", (None if i % 50 == 5 else int(bad) ^ (i % 30 == 0)), None))
        if i % 3 == 0:
            labels.append((i, "r2", int(bad), None))
    df = spark.createDataFrame(documents, "doc_id bigint, text string, source string")
    return abuse.weights_of(df, spark.createDataFrame(labels, "doc_id bigint, reviewer string, abusive int, h string"), "doc_id", "text", "abusive", **options)


def test_what_is_marked_is_learned_misspelt_too(spark):
    weights = taught(spark)
    lex = abuse.Lexicon(weights)
    for text in ("that zibbledorf sleeps again", "what a zibbeldorf he is", "get lost, z!bbled0rf", "go back under the snurk"):
        assert abuse.score_text(text, lex)["learned"] >= abuse.THRESHOLD, text
    for text in ("who sorted the lamps again", "the quokka sorted seven lamps", "", "the snark sorted lamps"):
        assert abuse.score_text(text, lex)["learned"] < abuse.THRESHOLD, text
    assert "zibbledorf" in weights.terms and "green" in weights.known


def test_the_sample_is_bounded_and_may_be_empty(spark):
    assert taught(spark, rows=0) is None
    documents = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id bigint, abusive int")
    assert abuse.weights_of(documents, labels, "doc_id", "text", "abusive") is None
    assert abuse.weights_of(documents, labels.limit(0), "doc_id", "text", "abusive") is None
    again = [taught(spark, rows=100) for _ in range(2)]
    assert again[0] == again[1]


def test_no_word_or_idiom_is_a_sentence():
    assert all(len(x.split()) <= 7 for block in L.IDIOMS.values() for x in block.split(","))


@pytest.mark.parametrize("text", [
    "I am going to stab you.", "We will break all the bones in your face", "You should die in a fire", "I hope you choke on it", "Someone should shoot you",
    "Ich werde dich erwürgen", "Te vamos a matar", "Je vais te tuer", "I know where your kids sleep", "Dutchmen should all be exterminated", "I despise immigrants",
    "he wants to lick my bare thighs", "Quiero lamer tus tetas", "Jungs, ich mach dich fertig",
])
def test_general_threats_hate_and_sexual_texts(text):
    assert max(abuse.score_text(text).values()) >= abuse.THRESHOLD


@pytest.mark.parametrize("text", [
    "I will kill your job if it hangs", "we should shoot for Friday", "You should burn the image to disk", "The fan will hurt throughput", "old rows should be deported to cold storage",
    "I know where your query is slow", "we will break the build", "I will never hurt you", "We beat them in latency",
])
def test_violence_against_machines_is_none(text):
    assert max(abuse.score_text(text).values()) < abuse.THRESHOLD


def test_texts_that_are_no_utf8(spark):
    df = spark.range(8).select(F.col("id").alias("doc_id"), F.expr("concat(cast(X'FFC3' AS string), ' you zibbledorf ', cast(id AS string))").alias("text"))
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("abusive"))
    weights = abuse.weights_of(df, labels, "doc_id", "text", "abusive")
    assert abuse.scores(df, "doc_id", "text", weights).count() == 8
