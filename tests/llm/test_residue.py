import random

import pytest
from pyspark.sql import functions as F

from loomspan.llm import queries, residue
from loomspan.llm.residue import SIMILARITY, jaccard, read_rules, signatures, template

PLACEHOLDERS = ["Hi {{ first_name }},\n\nreal text here", "Posted by {% block user %} today", "<%= date %>", "See #{title}", "${ticket.id}", "Dear {company}", "[[link]]", "<< user >>", "%(link)s", "%%user%%", "@@title@@", "##date##", "$product$", "__link__TODO__", "<INSERT name>", "[INSERT name HERE]", "[Your name here]", "[Name einfügen]"]
FILLER = ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "TBD", "tbd - content to follow", "xxx xxx xxx", "foo bar foo bar foo bar", "----------", "Heading 1: sample text to be replaced\nItem 2: sample copy to be replaced", "Text folgt in Kürze.", "[answer]", "Your answer goes here…"]
ERRORS = ["404 Not Found", "HTTP/1.1 502 Bad Gateway\ncontent-length: 0", '{"status": 504, "error": "Gateway Timeout"}', "<html><head><title>Error</title></head><body>500 Internal Server Error", "Home | Questions | Tags | Log in\n\nPage\nnot\nfound", "Access denied. Incident 7db03abf23 was logged.", "PAGE\xa0NOT\xa0FOUND", 'Traceback (most recent call last):\n  File "/srv/app/x.py", line 3, in show\nKeyError: \'a\'', "お探しのページは見つかりませんでした。"]
NOTICES = ["Please enable JavaScript to view this page.", "Loading…\nWithout scripts the answers can't be shown.", "Checking your browser before you can enter. This takes a few seconds.", "Bitte aktivieren Sie JavaScript, um die Antworten zu sehen.", "JS is disabled. You must activate it and try again.", "É preciso ligar o JavaScript para ler as respostas."]
REAL = ["Use `${RUN_ID}` in the overlay, not `%RUN_ID%`.", "```jinja\n{{ name }}\n```\nThis prints the name.", "```\n{{ never closed }}", "Page not found is what the browser shows since the folder moved.", 'The server answers "502 Bad Gateway" whenever the list is empty.', "Which users still run with JavaScript disabled? Our viewer needs it.", "When I enable JavaScript in the viewer the table appears.", "The placeholder rows in the table are on purpose.", "The report prints lorem ipsum where the summary should be.", "No.", "+1", "Thanks, that was it!", "Merci, ça marche. Merci, ça marche. Merci, ça marche.", "[tool] surprisingly small table\n\nWhy is it small?", "It costs $5 and $10, about 20 % and {1, 2}.", "Gone.", 'The pop-up shows "{{ stop.name }}" instead of the name.', "", " \n\t", None]


@pytest.mark.parametrize(("kind", "texts"), [("placeholder", PLACEHOLDERS), ("filler", FILLER), ("error", ERRORS), ("notice", NOTICES), (None, REAL)])
def test_rules(kind, texts):
    assert {t: read_rules(t)[0] for t in texts} == dict.fromkeys(texts, kind)


def test_simhash_of_near_texts():
    words = [f"w{i}" for i in range(60)]
    near = words[:57] + ["a", "b", "c"]
    texts = [" ".join(w) for w in (words, words, near, [f"v{i}" for i in range(60)], ["one"])]
    hashes, n, _ = signatures(texts)
    distance = lambda i, j: sum(bin((int(a) ^ int(b)) & (1 << 64) - 1).count("1") for a, b in zip(hashes[i], hashes[j]))
    assert distance(0, 1) == 0 and list(n) == [56, 56, 56, 56, 1]
    assert jaccard(texts[0], texts[2]) >= SIMILARITY and distance(0, 2) <= residue.MAX_HAMMING < distance(0, 3)


def test_template_ignores_numbers():
    assert template("ref 7db03abf23 took 15 s") == template("ref 12345abcde took 9 s")


def test_labels_spread_through_components(spark):
    base = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    variant = lambda *at: " ".join("changed" + str(i) if i in at else w for i, w in enumerate(base))
    head = "Lorem ipsum dolor amet "
    mock = " ".join(("lorem ipsum dolor sit amet elitra magnur tempora quilla consimo velat ullis".split() * 9)[i * 7 % 101] for i in range(100))
    near, further = mock + " etwas", "völlig " + mock + " etwas"
    rows = [(1, mock), (2, near), (3, further), (4, variant()), (5, variant(3)), (6, head + "is what the report prints, why?"), (7, None), (8, ""), (9, mock.upper())]
    found = {(r.doc_id, r.kind) for r in residue.find_residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, _ in found} == {1, 2, 3, 9}
    assert {d for d, k in found if k == "near_duplicate"} <= {2, 3}


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_near_duplicates_are_found_through_the_tables(spark, monkeypatch, broadcast):
    monkeypatch.setattr(residue, "BROADCAST_ROWS", broadcast)
    notice = "please enable javascript in your browser settings " + " ".join(f"{chr(97 + i)}ord" for i in range(26))
    docs = [(1, notice), (2, notice + " extra"), (3, "first " + notice + " extra"), (4, " ".join(f"other{chr(97 + i)}" for i in range(26))), (5, "too short"), (6, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    read = residue.features(df, "doc_id", "text").withColumnRenamed("doc_id", "rep").withColumn("kind", F.lit("notice")).cache()
    assert read.where("rep = 1").head().n == 29
    found = {tuple(r) for r in residue.near(read.where("rep = 1"), read.where("rep <> 1").drop("kind"), df).collect()}
    assert found == {(d, "notice") for d, t in docs if d != 1 and t and jaccard(notice, t) >= SIMILARITY} and len(found) == 2


def test_placeholder_copies_are_not_spread(spark):
    text = "You have to rename the skim matrix before you sort the link store, since the key is read as text and the join runs before the filter."
    rows = [(1, f"Hi {{{{ name }}}},\n\n{text}"), (2, f"Hi Anna,\n\n{text}"), (3, text)]
    assert {r.doc_id for r in residue.find_residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1}


def test_queries(spark, small, empty_folder, dirty_folder):
    found = {r.doc_id for r in queries.p10_found(spark, small).collect()}
    assert found and {r.doc_id for r in queries.p10_found(spark, dirty_folder).collect()} == found
    clean = queries.p10_clean(spark, small)
    assert found.isdisjoint({r.doc_id for r in clean.collect()}) and clean.columns == spark.read.parquet(f"{small}/documents.parquet").columns
    assert queries.p10_found(spark, empty_folder).count() == 0 and queries.p10_clean(spark, empty_folder).count() == 0


def test_very_long_text(spark):
    rows = [(1, "x" * 3_000_000), (2, "a real sentence about tables. " * 100_000), (3, "{" * 100_000), (4, "`" * 50_001)]
    assert {r.doc_id for r in residue.find_residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 3}


def planted(rng, words, n):
    """Pairs of a text of so many random words and a copy with one to four words changed or added, of similarity 0.8 to below 1."""
    word = lambda: "".join(rng.choices("abcdefghij", k=9))
    out = []
    while len(out) < n:
        base = [word() for _ in range(words)]
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            at = rng.choice([0, len(copy), rng.randrange(len(copy))])
            copy[at : at + rng.randint(0, 1)] = [word()]
        if SIMILARITY <= jaccard(" ".join(base), " ".join(copy)) < 1:
            out.append((" ".join(base), " ".join(copy)))
    return out


@pytest.mark.parametrize(("words", "by_tables"), [(8, 0.8), (12, 0.9), (20, 0.9), (40, 0.9), (150, 0.9)])
def test_recall_by_length(spark, words, by_tables):
    """All planted near-duplicates are found; the tables alone find nine in ten of texts of twelve words and more."""
    pairs = planted(random.Random(words), words, 300)
    docs = [(2 * k + side, t) for k, pair in enumerate(pairs) for side, t in enumerate(pair)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    read = residue.features(df, "doc_id", "text").withColumn("rep", F.col("doc_id")).withColumn("kind", F.lit("error")).cache()
    bases, copies = read.where("doc_id % 2 = 0"), read.where("doc_id % 2 = 1").drop("kind")
    assert {r.rep for r in residue.near(bases, copies, df).collect()} == {2 * k + 1 for k in range(300)}
    met = residue.by_tables(bases, copies).distinct().collect()
    assert len({r.b_rep for r in met if r.b_rep == r.a_rep + 1}) >= by_tables * 300


def test_tables_grow_with_the_frontier():
    sizes = [residue.table_sizes(n) for n in (0, 1, 250, 10**4, 10**6, 10**9)]
    assert [b for b, _ in sizes] == [8, 8, 10, 16, 22, 32]
    assert all(1 - (1 - residue.AGREE**b) ** t >= residue.RECALL for b, t in sizes)


LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."
MOCK_TEXTS = [LOREM, ".".join(LOREM.split(".")[:2]) + ".", LOREM.split(". ")[1] + ".", LOREM.split(". ")[2] + ".", f"<p>{LOREM}</p>\n\n<p>{LOREM}</p>", "1. Lorem ipsum dolor sit amet\n2. Consectetur adipiscing elit", "Lorem ipsum dolor sit amet, vestibulum placidus quorum fermentum, pellentesque sonantum egestas luminis curabitur."]
ABOUT_MOCK = [f'The report prints "{LOREM}" where the summary should be.', f"Der Bericht zeigt {LOREM}", f"{LOREM} Why is this shown instead of my text?", f"「{LOREM}」と表示されます", "El informe imprime lorem ipsum dolor en vez del texto.", "lorem ipsum filter option broken again", "Lorem ipsum generator: commit status format edit reset audit system"]


@pytest.mark.parametrize(("kind", "texts"), [("filler", MOCK_TEXTS), (None, ABOUT_MOCK)])
def test_mock_latin_beyond_the_words_of_the_tables(kind, texts):
    assert {t: read_rules(t)[0] for t in texts} == dict.fromkeys(texts, kind)


SERVER_PAGES = [
    "<html><head><title>502 Bad Gateway</title></head><body><center><h1>502 Bad Gateway</h1></center><hr><center>nginx/1.18.0</center></body></html>",
    "502 Bad Gateway\n502 Bad Gateway\nnginx",
    "Not Found\n\nThe requested URL /a/b.html was not found on this server.\n\nApache/2.4.41 (Ubuntu) Server at example.com Port 80",
    "Not Found. The requested URL /x was not found on this server.",
    "Forbidden\nYou don't have permission to access /private/ on this server.",
]
ABOUT_SERVERS = ["nginx", "nginx 502 bad gateway", "The requested URL /x was not found on this server. What can I do?", "Apache/2.4.41 (Ubuntu)", "nginx/1.18.0 answers 502 Bad Gateway"]
LONG = "a_very_long_variable_name_of_a_template_that_nobody_filled_in"
LONG_PLACEHOLDERS = [f"Hi {{{{ {LONG} }}}}, welcome", f"Hi {{{{ {LONG}\n | upper }}}}, welcome", f"[INSERT {LONG} HERE] is late", f"[Your {LONG} here]", f"[{LONG} einfügen]", f"[insérer {LONG}]", "{{" + " " * 50_000 + f"{LONG}" + " " * 50_000 + "}}"]


@pytest.mark.parametrize(("kind", "texts"), [("error", SERVER_PAGES), (None, ABOUT_SERVERS), ("placeholder", LONG_PLACEHOLDERS)])
def test_server_pages_and_long_placeholders(kind, texts):
    assert {t: read_rules(t)[0] for t in texts} == dict.fromkeys(texts, kind)


@pytest.mark.parametrize("text", ["{{ a", "[INSERT ", "[Your ", "[x ", "[insérer ", "[Your" + " " * 99])
def test_unclosed_placeholders_end(text):
    assert read_rules(text * 20_000)[0] is None


# Texts that had no part in making the rules.
UNSEEN = {
    "error": ["This page could not be loaded. Please refresh the browser.", "Sorry! The article you requested has been removed.", "502 - Web server received an invalid response while acting as a gateway or proxy server.", "The connection to the server was reset while the page was loading.", "Le serveur est indisponible. Veuillez réessayer plus tard.", "This account is unavailable.", "Your session has timed out, please log in again."],
    "notice": ["JavaScript must be enabled to view these comments.", "Activate scripts to load this thread.", "Your browser does not support JavaScript.", "Scripts are blocked on this page. Allow them and refresh.", "Checking your connection, please wait a moment.", "Esta aplicación necesita JavaScript para funcionar."],
    "filler": ["Your content goes here.", "Sample page. Replace this text.", "Type your answer here", "Dummy content, to be replaced later", "lorem ipsum dolor sit amet lorem ipsum dolor sit amet"],
    None: ["Add the zone column here and run the skim step.", "The page table is full, so raise the limit of the pool.", "It needs the network file, not the matrix.", "JavaScript is used for the map layer of our viewer.", "We removed the link in the last release.", "Enable the flag and compare the two runs.", "The timeout is 30 s by default."],
}


def test_rules_on_unseen_texts():
    """Seven of ten residue texts are told, with their kind; no real text is taken for residue."""
    told = [(kind, read_rules(t)[0]) for kind, texts in UNSEEN.items() if kind for t in texts]
    assert sum(a == b for a, b in told) >= 0.7 * len(told)
    assert {read_rules(t)[0] for t in UNSEEN[None]} == {None}
