import random
import time
from html.parser import HTMLParser

from wordloom.llm.html_extract import RAW, VOID, extract, main_text, parse

A = "The river rose in the night, and by morning the lower fields, the barns and the road were under water."
B = "Nobody had seen such a flood, the old people said, since the bridge was built, and that was long ago."
C = "Short remark, kept."
MENU = '<ul><li><a href="/a">Home page</a></li><li><a href="/b">All the news</a></li><li><a href="/c">About us</a></li></ul>'


def test_marked_up_page():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no, no, no</p>";</script></head>
    <body><header><h2>Site, the best site, of all</h2>{MENU}</header><div class="cookie-notice"><p>We use cookies, many cookies,
    and more cookies, to serve you and our partners better.</p></div><nav>{MENU}</nav><div class="sidebar"><p>Sidebar words,
    and more words, that go on, and on, for a long time, but do not matter at all.</p></div><!-- <p>{A}</p> -->
    <article><h1>Flood &amp; field</h1><p>{A}</p><p><b>{B}<br><p>{C}</p><form><p>Sign up, now, and get, all, mails.</p><input></form>
    <div class="ad">Buy, buy, buy this thing, it is very good, and cheap.</div></article>
    <section id="comments"><p>First, I must say, this comment is long, long, long, and full of commas, to score well.</p></section>
    <footer>&copy; us, all rights, reserved</footer>"""
    assert main_text(page) == f"Flood & field\n{A}\n{B}\n{C}"


def test_only_divs():
    page = f"""<body><div id="top"><div class="menu">{MENU}</div></div><div id="wrap"><div class="c1"><h1>Head</h1>
    <p>{A}</p><p>{B}  with&nbsp;<i>some</i> <a href=x>link</a></p><ul><li>{C}</ul></div><div class="links">{MENU}</div></div>
    <div class="foot"><a href="/">Legal</a> <a href="/">Privacy</a></div></body>"""
    assert main_text(page) == f"Head\n{A}\n{B} with some link\n{C}"


def test_cut_off_and_odd():
    assert main_text(f"<article><p>{A}</p><p>{B} &am") == f"{A}\n{B} &am"
    assert main_text(f"<article><p>{A}</p><p>{B}<b cla") == f"{A}\n{B}"
    assert main_text("<script>never closed <p>x</p>") == ""
    assert main_text("plain words, no markup, at all") == "plain words, no markup, at all"
    assert main_text("<div>" * 3000 + f"<p>{A}</p>") == A
    assert main_text("") == main_text("<p> </p>") == ""


def test_query(spark):
    rows = [(1, "u", f"<p>{A}</p>"), (1, "u", f"<p>{A}</p>"), (2, None, None), (3, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS n_chars", "2 AS text")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract(df).collect()), key=str)
    assert got == [(1, "u", A, len(A))] * 2 + [(2, None, "", 0), (3, "v", "", 0)]
    assert extract(df.limit(0)).count() == 0


class Plain(HTMLParser):
    """Nested lists of the elements of a well-formed page, by the standard library's tokenizer."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [["html"]]

    def handle_starttag(self, tag, attrs):
        self.stack[-1].append([tag])
        if tag not in VOID:
            self.stack.append(self.stack[-1][-1])

    def handle_endtag(self, tag):
        assert self.stack.pop()[0] == tag

    def handle_data(self, data):
        if self.stack[-1][0] not in RAW:
            self.stack[-1].append(data)


def nested(node):
    return [node.tag, *(nested(c) if not isinstance(c, str) else c for c in node.children)]


def joined(tree):
    """Neighbouring texts as one."""
    out = [tree[0]]
    for c in tree[1:]:
        if isinstance(c, str) and len(out) > 1 and isinstance(out[-1], str):
            out[-1] += c
        else:
            out.append(joined(c) if isinstance(c, list) else c)
    return out


def some_html(r, depth=0):
    out = []
    for _ in range(r.randint(1, 4)):
        kind = r.randint(0, 7)
        if kind <= 2 or depth > 5:
            out.append(r.choice(["words, words", " a < b & c ", "x &amp; y &lt;p&gt; &eacute;&#8217;", "\n", "1 > 0", "“ü”"]))
        elif kind == 3:
            out.append(r.choice(["<!-- <p>no</p> > -->", "<br>", "<img alt='a > b' src=x>", '<hr class="x y">', "<input disabled>"]))
        elif kind == 4:
            out.append(r.choice(["<script>if (a < b) { t = '</p>'; }</script>", "<style>p > a {}</style>"]))
        else:
            tag = r.choice(["div", "section", "span", "b", "em", "a", "ul", "DIV"])
            attributes = r.choice(["", ' class="a>b"', " id='q \" q'", " data-x=1 hidden", ' title = "t"', "\n\tstyle=\"x: y\""])
            out.append(f"<{tag}{attributes}>{some_html(r, depth + 1)}</{tag}>")
    return "".join(out)


def test_tree_is_that_of_another_parser():
    r = random.Random(4)
    for _ in range(400):
        page = some_html(r)
        other = Plain()
        other.feed(page)
        other.close()
        assert joined(nested(parse(page))) == joined(other.stack[0]), page


def test_pages_of_known_text():
    """Articles in frames of several makes, with what is not theirs around and within them."""
    r = random.Random(5)
    sentence = lambda: " ".join(r.choice(["stone", "river", "winter", "of", "the", "and", "light"]) for _ in range(r.randint(8, 25))).capitalize() + r.choice([".", ", so they said.", "!"])
    paragraph = lambda: " ".join(sentence() for _ in range(r.randint(2, 6)))
    links = lambda n: "<ul>" + "".join(f'<li><a href="/{i}">{r.choice(["Home", "News", "Contact us"])}</a></li>' for i in range(n)) + "</ul>"
    around = [
        lambda: f"<nav>{links(6)}</nav>", lambda: f'<div class="sidebar"><h3>More</h3>{links(5)}<p>{paragraph()}</p></div>',
        lambda: f'<div id="cookie-banner"><p>{paragraph()}</p><button>OK</button></div>', lambda: f"<aside><p>{paragraph()}</p></aside>",
        lambda: f'<div class="ad">{sentence()}</div>', lambda: "<script>var x = '<p>no</p>';</script>", lambda: f"<!-- <p>{paragraph()}</p> -->",
    ]
    for _ in range(150):
        blocks = [sentence().rstrip(".!")[:40].strip()] + [paragraph() for _ in range(r.randint(3, 8))]
        body = f"<h1>{blocks[0]}</h1>"
        for b in blocks[1:]:
            first, _, rest = b.partition(" ")
            marked = r.choice([b, f"<b>{first}</b> {rest}", f'{first} <a href="/x">{rest.partition(" ")[0]}</a> {rest.partition(" ")[2]}', f"{first}\n   {rest}"])
            body += f"<p>{marked}" + r.choice(["</p>", ""])
            if r.random() < 0.2:
                body += r.choice(around)()
        start, end = r.choice([("<article>", "</article>"), ("<main><div>", "</div></main>"), ('<div class="post-content">', "</div>")])
        comments = f'<section id="comments"><h2>2 comments</h2><p>{paragraph()}</p><p>{paragraph()}</p></section>' if r.random() < 0.5 else ""
        parts = [r.choice(around)() for _ in range(r.randint(1, 4))]
        page = f"<!doctype html><html><head><title>t</title></head><body>{''.join(parts)}{start}{body}{end}{comments}{r.choice(around)()}<footer><p>{sentence()}</p></footer></body></html>"
        assert main_text(page) == "\n".join(blocks), page


def test_broken_pages_in_linear_time():
    for bad in ("<a b", "</x>", '<a b="', "<p><b>", "<td>", "<!", "<a href='x\">", "< ", "</", "<ul><li>", '<div class="a"><a href=x>l</a>'):
        begun = time.process_time()
        main_text(bad * (1_000_000 // len(bad)))
        assert time.process_time() - begun < 15, bad
    begun = time.process_time()
    main_text("<a b" * 250_000)
    assert time.process_time() - begun < 1
    r = random.Random(6)
    for _ in range(500):
        assert isinstance(main_text("".join(r.choice(["<", ">", "/", "p", "div", " ", "=", '"', "'", "!", "--", "a", "&", "<p>", "text, text"]) for _ in range(60))), str)
