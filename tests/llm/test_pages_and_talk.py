"""Pages, archives and conversations."""

import hashlib

from claimscope.llm.archives import END, MAGIC, read_archives, write_archives
from claimscope.llm.main_text import extract_main_text, main_text
from claimscope.llm.reply_trees import as_trees, digest_conversations, escape, format_trees, format_turn, parse, unescape

LINE = "This is the first line of the text and it is long enough to be decided by its own words here. "


def test_main_text_of_an_article():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><a href=/>Home</a></header>
    <nav><ul><li><a href=/a>A</a></ul></nav><div class="ad">{LINE}</div><!-- <p>x</p> --><article><header><h1>Head &amp; &lt;b&gt;</h1></header>
    <p>{LINE}<b>bold</b><p>Short.<p>{LINE}</p><aside>{LINE}</aside><div class="comments"><p>{LINE}</p></div></article>
    <form>{LINE}</form><script>var x = "</p>";</script><footer>&copy; {LINE}</footer></body></html>"""
    assert main_text(page) == "\n".join(["Head & <b>", LINE + "bold", "Short.", LINE.strip()])


def test_main_text_without_an_article_and_odd_pages():
    page = f"<div><a href=1>one</a> <a href=2>two</a></div><p>{LINE * 3}<p>Short one.<p>{LINE * 3}<div class='cookie-notice'>{LINE}</div>"
    assert main_text(page) == "\n".join([(LINE * 3).strip(), "Short one.", (LINE * 3).strip()])
    assert main_text("") == "" and main_text("<") == "" and main_text("<article>a < b</article>") == "a < b"
    assert main_text("<article><p>Only short</article>") == "Only short"
    assert main_text("<p" + " a='" * 20_000) == "" and len(main_text("<article>" + "<div>" * 3000 + "x")) == 1


def test_bodies_of_raw_text_elements_are_no_markup():
    for raw in ("<script>for(var i=0;i<n;i++){f(i)}</script>", "<SCRIPT>if(a<b)c()</Script >", "<script><!-- x</script>", "<style>a<b{}</style>",
                "<title>a <b</title>", "<textarea>x<y</textarea>", "<noscript><!-- <img a='</noscript>", "<script>a</scripts><p></script>",
                "<svg><style>a<b</style></svg>"):
        assert main_text(f"<article>{raw}<p>{LINE}</p><script>x</script><p>{LINE}</p></article>") == f"{LINE.strip()}\n{LINE.strip()}", raw
    assert main_text(f"<article><p>{LINE}</p><script>a<b <p>{LINE}</p>") == LINE.strip()


def test_a_wrapper_with_a_hint_does_not_outweigh_the_text_in_it():
    text = "\n".join([LINE.strip()] * 3)
    body = f"<p>{LINE}</p><p>{LINE}</p><p>{LINE}</p>"
    side = f"<div class='sidebar'><p>{LINE}</p></div><div class='comments'><article><p>{LINE * 9}</p></article></div>"
    for wrapper in ("<form action=x>", "<div class='has-sidebar'>", "<div class='content-with-sidebar'>", "<div class='search results'>", "<div id=nav-open>",
                    "<form><div class='has-sidebar'>", "<fieldset>"):
        for inner in (f"<main>{body}</main>{side}", f"<article>{body}</article>{side}", f"{body}<div class=sidebar><p>{LINE}</p></div>"):
            assert main_text(f"<body>{wrapper}<nav>{LINE}</nav>{inner}<footer>{LINE}</footer>") == text, (wrapper, inner)
        assert main_text(f"{wrapper}<article><p>Only short</article>") == "Only short"
    assert main_text(f"<article><h1>Head</h1><div class='no-sidebar'>{body}</div></article>") == f"Head\n{text}"
    assert main_text(f"<div class=promo><article>{body}</article></div><div class=promo><article>{body}</article></div>") == f"{text}\n{text}"


def test_place_still_leaves_out_what_is_beside_the_text():
    text = "\n".join([LINE.strip()] * 3)
    body = f"<p>{LINE}</p><p>{LINE}</p><p>{LINE}</p>"
    for beside in (f"<form><p>{LINE}</p></form>", f"<div class=related><article><p>{LINE}</p></article></div>", f"<div class=comments><p>{LINE * 9}</p></div>",
                   f"<div class=cookie><p>{LINE * 4}</p></div>", f"<aside><article>{LINE * 9}</article></aside>", f"<div hidden><main>{LINE * 9}</main></div>"):
        assert main_text(f"<article>{body}</article>{beside}") == text, beside
        assert main_text(f"<form>{beside}<main>{body}</main></form>") == text, beside
    assert main_text(f"<article><p>Only short</article><div class=comments>{LINE}</div>") == "Only short"


def test_unclosed_dropped_elements_end_at_the_next_block():
    for name in "button select option video audio canvas svg template".split():
        for broken in (f"<div><{name}>Menu</div>", f"<{name}>Menu", f"<div><{name}>a<{name}>b</{name}></div>"):
            assert main_text(f"<article>{broken}<p>{LINE}</p><p>{LINE}</p></article>") == f"{LINE.strip()}\n{LINE.strip()}", broken
    whole = "<select><option>a<option>b<optgroup><option>c</select><button><div>d</div>e</button><svg><svg></svg><text>f</text></svg>"
    assert main_text(f"<article><p>{LINE}</p>{whole}<datalist><option value=1></datalist><p>{LINE}</p></article>") == f"{LINE.strip()}\n{LINE.strip()}"
    formula = "<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding=tex>x=1</annotation></math> <object data=a><b>as text</b></object>"
    assert main_text(f"<article><p>{LINE}{formula}</p></article>") == f"{LINE}x=1 as text"
    assert main_text("<article>" + "<button>" * 50_000 + f"<p>{LINE}</p></article>") == LINE.strip()


def test_pages_keep_their_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<article>x</article>")], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in extract_main_text(pages.selectExpr("*", "1 AS text")).collect()) == [("", 0), ("", 0), ("x", 1)]


def test_archives_with_magic_in_payloads(spark, tmp_path):
    evil = "x" * 600 + f"{MAGIC}WARC-Type: response\r\nX-Page-Id: 5\r\nContent-Length: 3{END}abc{END}{MAGIC}{MAGIC}" + "é" * 500
    html = [(i, "http://u", f"<p>{i}</p>") for i in range(40)] + [(50, "u", evil), (51, "u", evil), (52, "u", MAGIC), (53, None, None), (54, "a\r\nb", ""), (60, "u", "y" * 999), (61, "u", "y" * 999)]
    html += [(70, "u", "z" * 2000), (70, "u", "z" * 2000), (69, "u", "z" * 2000), (None, "u", "no id")]
    folder = str(tmp_path / "archive")
    write_archives(spark.createDataFrame(html, "page_id long, url string, html string").selectExpr("*", "1 AS digest"), folder, most_records=15)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1111")
    try:
        found = read_archives(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = []
    for page, _, body in html:
        data = (body or "").encode()
        largest = max((p for p, _, b in html if b == body and p is not None), default=None)
        refers = largest if len(data) >= 1000 and page is not None and page < largest else None
        want.append((page or -1, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers or -1))
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in found) == sorted(want)


def test_an_archive_without_pages(spark, tmp_path):
    folder = str(tmp_path / "none")
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert read_archives(spark, folder).count() == 0


def test_escapes_are_reversible():
    for text in ["", "\\", "a\\</s>b", "\\\\[INST]\\", "</s>[INST] ok [/INST]", "\n</s>\n", "<s></s>\\\\\\<s>", "\n"]:
        assert unescape(escape(text)) == text
        for role in ["user", "assistant", "", "a\\n\nb", "<s>"]:
            turn, _ = format_turn(role, text, 0)
            assert parse(turn * 2) == [(role, text)] * 2


def test_branches_are_ranked_and_circles_left_out(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5), (1, 5, 3, "user", "x", 0.4)]
    rows += [(1, 8, 9, "u", "c", 1.0), (1, 9, 8, "u", "c", 1.0), (2, 1, 77, None, None, None), (None, 1, None, "user", "n", 1.0), (1, 3, 1, "assistant", "good", 0.9)]
    trees = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    one = {r.tree_id: parse(r.formatted) for r in format_trees(trees).collect()}
    assert one == {1: [("user", "q"), ("assistant", "good"), ("user", "more")], 2: [("", "")], None: [("user", "n")]}
    assert format_trees(trees, 2).count() == 4 and format_trees(trees.limit(0)).count() == 0


def test_conversations_round_trip(spark):
    turns = [(1, n, "user" if n % 2 else "assistant", f"t{n}</s>") for n in range(70)] + [(2, 0, "user", None), (2, 0, "user", None), (3, 5, "assistant", "")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in digest_conversations(format_trees(as_trees(rows))).collect()}
    for conv in (1, 2, 3):
        own = [(r, t or "") for c, _, r, t in turns if c == conv]
        said = "".join(t for r, t in own if r == "assistant")
        assert found[conv].n_turns == len(own)
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
