import random

from llm.tables import shown

from offerlens.llm.html_text import Rules, blocks, first_pass, main_text, page_texts, second_pass

LONG = "The storm reached the coast in the early hours of the morning, and it was the worst that the town had seen for many years, said the mayor."
MORE = "It is not clear when the harbour will open again, as the boats that were lost are still in the way of those who want to go out to sea."

TEMPLATE = f"""<!DOCTYPE html><html><head><title>Storm - News</title><style>p{{x:1}}</style><script>if (a<b) document.write("<p>{LONG}</p>")</script></head>
<body class="page with-sidebar"><header><h1>The Daily</h1><p>{LONG}</p></header>
<nav><ul><li><a href=/>Home</a></li><li><a href="/s?a=1&b=2">Sport</a></ul></nav>
<div class="cookie-banner">We use cookies. {LONG}</div><!-- <p>{MORE}</p> -->
OPEN<h2>Storm hits coast</h2><p>{LONG}<p>Short &amp; sweet&nbsp;&mdash; <b>yes</b>,   it
is.</p><div class='ad wide'>{MORE}</div><p>{MORE}</p><ul><li>One item</li><li>Another &lt;item&gt;</li></ul>CLOSE
<aside><p>{LONG}</p></aside><div id="comments"><p>{MORE}</p><p>I agree with the mayor.</p></div>
<form><label>Mail</label><p>{LONG}</p></form><footer><p>&copy; 2020 The Daily {MORE}</p></footer></body></html>"""
TEXT = "\n".join(["Storm hits coast", LONG, "Short & sweet — yes, it is.", MORE, "One item", "Another <item>"])


def page(start, end):
    return TEMPLATE.replace("OPEN", start).replace("CLOSE", end)


def test_article_without_the_rest():
    assert main_text(page("<article>", "</article>")) == TEXT


def test_rules_decide_where_no_container_tells():
    found = main_text(page("<div><div>", "</div></div>")).split("\n")
    assert found[:4] == TEXT.split("\n")[:4]
    assert not any("cookies" in line or "agree" in line or "Daily" in line or "Sport" in line for line in found)


def test_link_lists_and_short_blocks():
    links = "".join(f'<li><a href="/{i}">Read this other story about the town</a></li>' for i in range(5))
    html = f"<body><div>{links}</div><div><p>{LONG}</p><p>Yes.</p><p>{MORE}</p></div><div>{links}</div><p>Imprint</p>"
    assert main_text(html) == f"{LONG}\nYes.\n{MORE}"


def test_broken_markup():
    assert main_text(f"<article><p>{LONG}<p>a < b & c &am d<br>e<br/><br>f") == f"{LONG}\na < b & c &am d e\nf"
    assert main_text(f'<article><p title="x>y">{LONG}</p><p title="open>{MORE}') .startswith(LONG)
    assert main_text(f"<article><p>{LONG}</article></div></nav><script>x") == LONG
    assert main_text(f"<article><nav><p>{MORE}</p><article><p>{LONG}</p>") == ""
    for page in (None, "", "   ", "<", "<>", "</", "<!--", "<script>", "&", "\x00"):
        main_text(page)
    assert main_text("<article>" + "<div>" * 5000 + LONG) == LONG
    assert len(main_text("<article>" + f"<p>{LONG}</p>" * 3000).split("\n")) == 3000


def test_choices_and_unclosed_elements_lose_no_article_text():
    both = f"{LONG}\n{MORE}"
    datalist = "<datalist id=l><option value=A><option value=B>Bee</datalist>"
    assert main_text(f"<article><p>{LONG}</p>{datalist}<p>{MORE}</p></article>") == both
    select = "<select><optgroup label=x><option>One<option selected>Two</option></select>"
    assert main_text(f"<article><p>{LONG}</p><p>Choose {select} now</p></article>") == f"{LONG}\nChoose now"
    assert main_text(f"<article><option>A<p>{LONG}</p><p>{MORE}</p>").endswith(both)
    for name in "object iframe svg noscript template".split():
        assert main_text(f"<article><p>{LONG}</p><{name} class=a><p>{MORE}</p></article>") == both
    for name in "iframe svg noscript template script style textarea title".split():
        assert main_text(f"<article><p>{LONG}</p><{name} a=b>x</{name.upper()} ><p>{MORE}</p><{name}/></article>") == both
    for name in "script style textarea title".split():
        assert main_text(f"<article><p>{LONG}</p><{name}><p>{MORE}</p></article>") == LONG
    assert main_text(f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>") == f"{LONG} x=1"
    assert main_text("<article>" + "<svg>" * 50_000 + LONG) == LONG


def test_odd_rows(spark):
    rows = [(1, "u", f"<article>{LONG}</article>"), (2, None, None), (None, "v", ""), (1, "u", f"<article>{LONG}</article>")]
    df = spark.createDataFrame([(*row, "x", 5) for row in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = shown(page_texts(df), "page_id", "url", "text", "n_chars")
    assert got == sorted([(1, "u", LONG, len(LONG)), (2, None, "", 0), (None, "v", "", 0), (1, "u", LONG, len(LONG))], key=repr)
    assert page_texts(df.limit(0)).count() == 0


def plain(rows):
    """The second pass by comparing the container paths of all blocks. Rows: path, article depth, heading, label."""
    out = []
    for i, (path, article, heading, label) in enumerate(rows):
        if label is not None:
            out.append(label)
            continue
        sides = []
        for order in (range(i - 1, -1, -1), range(i + 1, len(rows))):
            j = next((j for j in order if rows[j][3] is not None), None)
            if j is not None:
                common = 0
                while common < min(len(path), len(rows[j][0])) and path[common] == rows[j][0][common]:
                    common += 1
                if not article or common > article or common == article and rows[j][3]:
                    sides.append((common, j))
        near = [j for common, j in sides if common == max(c for c, _ in sides)]
        if heading and near and near[-1] > i:
            near = [near[-1]]
        near = [j for j in near if abs(j - i) == min(abs(k - i) for k in near)]
        out.append(any(rows[j][3] for j in near) or (article > 0 and not near))
    return out


def test_second_pass_equals_comparing_all_blocks():
    rng = random.Random(4)
    kinds = [(f"<p>{LONG}</p>", False, True), ('<p><a href="/">More of this</a></p>', False, False), ("<p>Yes.</p>", False, None), ("<h2>Why</h2>", True, None)]
    open_blocks = 0
    for _ in range(300):
        rows, numbers = [], iter(range(10_000))

        def grown(path, article):
            html = ""
            for _ in range(rng.randrange(1, 5)):
                if len(path) < 5 and rng.random() < 0.4:
                    tag = "article" if not article and rng.random() < 0.2 else "div"
                    own = (*path, next(numbers))
                    html += f"<{tag}>{grown(own, len(own) if tag == 'article' else article)}</{tag}>"
                else:
                    markup, heading, label = rng.choices(kinds, (2, 2, 4, 1))[0]
                    rows.append((path, article, heading, label))
                    html += markup
            return html

        found = blocks(grown((), 0))
        labels = [first_pass(block, Rules()) for block in found]
        assert labels == [row[3] for row in rows]
        assert second_pass(labels, found) == plain(rows)
        open_blocks += labels.count(None)
    assert open_blocks > 500


def test_containers_are_near_and_an_article_without_long_blocks_stays():
    links = "<ul>" + '<li><a href="/x">Another story</a></li>' * 3 + "</ul>"
    html = f"<body><div><p>{LONG}</p><p>One.</p><p>Two.</p><p>Three.</p></div>{links}<div><p>Imprint</p>{links}</div></body>"
    assert main_text(html) == f"{LONG}\nOne.\nTwo.\nThree."
    assert main_text(f"<body>{links}<article><h1>Title</h1><p>Short.</p></article>{links}</body>") == "Title\nShort."
    assert main_text(f"<body>{links}<article><p>Short.</p>{links}<p>End.</p></article></body>") == "Short.\nEnd."
