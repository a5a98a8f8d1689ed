"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides what is clear: blocks in
containers for menus, headers, footers, adverts, comments and the like, or made of links, are
boilerplate; very long blocks, and long ones with many stop words, are text. An article container
lowers the length from which a block is text, but decides none by itself. Blocks that are short or
otherwise ambiguous stay open, and the second pass gives them the label of the nearest decided
neighbours: nearest in the tree of containers, then in page order. Where an article holds no
decided block at all, its open blocks are text.

Defined results: a null, empty or textless html gives an empty text; tags left open end with the
page, but for raw elements like svg or iframe, which without an end tag are their start tag alone;
what looks like no tag or character reference is text; each row is decided by itself.
"""

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text. Those of the first line go on to the end of the page if nothing ends them.
RAW_TO_END = "script style textarea title"
RAW = f"{RAW_TO_END} noscript template svg iframe"
RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW.split()}
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW.replace(" ", "|")})(?=[\s/>])[^>]*>"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?>(?:[^<>"']|"[^"]*"|'[^']*')*)|[^>]*)>|<[!?/][^>]*>""",
    re.DOTALL | re.IGNORECASE,
)
HINT = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: Elements that other start tags do not close, so that an open one lasts until its end tag.
CONTAINERS = frozenset(
    "article aside blockquote body button datalist details dialog div dl fieldset figure footer form header main menu nav ol section "
    "select span table ul".split()
)
#: Containers of choices, inside a line; their text is left out.
CHOICES = frozenset("datalist select".split())
BOILERPLATE_TAGS = frozenset("aside button dialog fieldset footer form menu nav".split())
# words in class, id or role that name a container for something else than the article
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments consent "
    "contentinfo cookie cookies copyright dialog discussion disclaimer disqus footer form gdpr header login masthead menu menubar modal nav "
    "navbar navigation newsletter notice notices notification outbrain pagination pager paywall popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar sidenav signup skip social sponsor sponsored "
    "subscribe taboola tags toc toolbar topbar warning widget widgets".split()
)
# fixed values: frequent function words of English, German, French and Spanish
STOP_WORDS = frozenset(
    "the of and a to in is that it was for on are as with be at by this have from or not but "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "le la les de des du et en un une que qui est dans pour ce il au sur pas plus par avec ne se sont "
    "el los las y del se con por una su para al lo como más o pero sus no".split()
)


@dataclass(frozen=True)
class Rules:
    """Limits in characters and shares of characters or words."""

    short: int = 70
    long: int = 100
    very_long: int = 200
    links: float = 0.34
    stop_words: float = 0.15


@dataclass
class Block:
    text: str
    linked: int
    boilerplate: bool
    heading: bool
    article: int  # depth of the article container around it, 0 for none
    low: int  # least depth of open containers since the block before


class _Page:
    """Keeps the open containers while the tags of a page go by."""

    def __init__(self):
        self.open: list[tuple[str, bool, int, bool]] = []  # name, boilerplate, depth of the article, choices
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.links = self.breaks = self.low = 0
        self.heading = False

    def state(self) -> tuple[bool, int]:
        return self.open[-1][1:3] if self.open else (False, 0)

    def choices(self) -> bool:
        return bool(self.open) and self.open[-1][3]

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            boilerplate, article = self.state()
            self.blocks.append(Block(text, self.linked, boilerplate, self.heading, article, self.low))
            self.low = len(self.open)
        self.parts, self.linked, self.breaks = [], 0, 0

    def text(self, raw: str) -> None:
        if raw and not self.choices():
            decoded = html.unescape(raw)
            self.parts.append(decoded)
            if decoded.strip():
                self.breaks = 0
            if self.links:
                self.linked += len("".join(decoded.split()))

    def tag(self, name: str, end: bool, attrs: str) -> None:
        if name == "br":
            self.breaks += 1
            self.parts.append(" ")
            if self.breaks == 2:
                self.flush()
            return
        if name == "a":
            self.links = 0 if end else 1
            return
        if name in BLOCKS:
            self.flush()
            self.heading = not end and name in ("h1", "h2", "h3", "h4", "h5", "h6")
            self.links = 0
        if name not in CONTAINERS:
            return
        if not end:
            if not attrs.endswith("/"):
                boilerplate, article = self.state()
                named = self.boilerplate(name, attrs, article > 0)
                if named and name == "span":
                    self.flush()
                inside = len(self.open) + 1 if name in ("article", "main") else article
                self.open.append((name, boilerplate or named, 0 if named else inside, name in CHOICES or self.choices()))
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                if name == "span" and self.open[i][1] != (self.open[i - 1][1] if i else False):
                    self.flush()
                del self.open[i:]
                self.low = min(self.low, i)
                break

    @staticmethod
    def boilerplate(name: str, attrs: str, article: bool) -> bool:
        if name in BOILERPLATE_TAGS or name == "header" and not article:
            return True
        if not attrs or name in ("body", "article", "main"):
            return False
        words = {word for found in HINT.findall(attrs) for word in re.split(r"[^a-z]+", "".join(found).lower())}
        return bool(words & BOILERPLATE_WORDS) or bool(HIDDEN.search(attrs))


def blocks(page: str) -> list[Block]:
    state, at, endless = _Page(), 0, set()
    while token := TOKEN.search(page, at):
        state.text(page[at : token.start()])
        at = token.end()
        if token["tag"]:
            state.tag(token["tag"].lower(), bool(token["end"]), token["attrs"])
        elif token["raw"] and not token[0].endswith("/>") and (name := token["raw"].lower()) not in endless:
            if end := RAW_END[name].search(page, at):
                at = end.end()
            elif name in RAW_TO_END.split():
                at = len(page)
            else:
                endless.add(name)  # so that no page is searched twice for what it lacks
    state.text(page[at:])
    state.flush()
    return state.blocks


def first_pass(block: Block, rules: Rules) -> bool | None:
    """True for text, False for boilerplate, None if the block alone does not tell."""
    letters = len(block.text.replace(" ", ""))
    if block.boilerplate or block.linked > rules.links * letters:
        return False
    if block.text.startswith("©") and not block.article:
        return False
    if len(block.text) >= rules.very_long:
        return True
    if len(block.text) < rules.short or block.heading:
        return None
    words = block.text.lower().split()
    density = sum(word.strip(".,;:!?\"'()") in STOP_WORDS for word in words) / len(words)
    if density >= rules.stop_words and (block.article or len(block.text) >= rules.long):
        return True
    if "©" in block.text and density < rules.stop_words and not block.article:
        return False
    return None


def _decided_before(labels: list[bool | None], lows: list[int]) -> list[tuple[int, int] | None]:
    """Per block the place of the last decided one before it, and the depth of the container around both."""
    found, last = [], None
    for i, label in enumerate(labels):
        if last is not None:
            last = (last[0], min(last[1], lows[i]))
        found.append(last)
        if label is not None:
            last = (i, 1 << 30)
    return found


def second_pass(labels: list[bool | None], found: list[Block]) -> list[bool]:
    """Open blocks take the label of the nearer decided neighbour; of two as near, text wins.

    The neighbour with the deeper common container is the nearer one, then that of fewer blocks
    between. A heading belongs to what follows it, unless that is in another container. Inside an
    article only neighbours in the article count, and boilerplate only where a container of its own
    holds both; where none counts, the block is text.
    """
    size = len(labels)
    before = _decided_before(labels, [block.low for block in found])
    # seen from the end, the step from a block to the next is the one that led to the next
    lows = [0, *(block.low for block in reversed(found))][:size]
    after = [side and (size - 1 - side[0], side[1]) for side in reversed(_decided_before(labels[::-1], lows))]
    decided = []
    for i, (label, block) in enumerate(zip(labels, found)):
        if label is not None:
            decided.append(label)
            continue
        sides = [side for side in (before[i], after[i]) if side]
        if block.article:
            sides = [(j, depth) for j, depth in sides if depth >= block.article + (not labels[j])]
        deepest = max((depth for _, depth in sides), default=0)
        near = [j for j, depth in sides if depth == deepest]
        if block.heading and near and near[-1] > i:
            near = near[-1:]
        least = min((abs(j - i) for j in near), default=0)
        decided.append(any(labels[j] for j in near if abs(j - i) == least) or bool(block.article and not near))
    return decided


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    found = blocks(page or "")
    labels = second_pass([first_pass(block, rules) for block in found], found)
    return "\n".join(block.text for block, keep in zip(found, labels) if keep)


def extracted(page: Column, rules: Rules = Rules()) -> Column:
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page, rules) for page in batch.to_pylist()], pa.string())

    return F.arrow_udf(of, "string")(page)


def page_texts(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    texts = pages.select("page_id", "url", extracted(F.col("html"), rules).alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))
