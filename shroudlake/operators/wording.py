"""What a task says: whom it names and what it wants said, searched or booked.

A task is cut into pieces: a quoted stretch or a word, each with the blanks after it, so any stretch of pieces can be put together again as it was. Readers look for a verb and then take the pieces after it in turn;
a reading is a struct, or null where the pieces do not fit. All of it is column expressions over one array of pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import drop_bracketed, strip

#: The words of requests.
SEND = ("send", "message", "tell", "text")
SAYING = ("that", "saying")
THINGS = ("message", "text", "note", "chat")
QUOTED_THINGS = (*THINGS, "greeting", "wish")
PRONOUNS = ("him", "her", "them")
OPENERS = ("i", "we", "you", "he", "she", "they", "please", "call", "meeting", "let", "can", "will", "dont", "am", "are", "is", "hello", "hi", "hey")
LOOK = ("play", "watch", "click", "open", "select")
SITES = ("youtube", "google", "flipkart", "amazon", "myntra", "meesho", "site", "page", "web")
SUBMIT = ("send", "press", "hit")
#: What no contact is called.
NO_NAMES = (
    "i", "this chat", "chat which is open", "the chat", "chat", "someone", "him", "her", "them", "this", "open chat", "active chat", "user", "message", "a message", "the message", "poem", "song", "story",
    "lines", "line", "love", "photo", "image", "video", "text", "a text", "the text", "audio", "note", "somethin", "something", "everything", "anything", "that", "it", "its", "me", "you", "us", "he", "she",
    "they", "a", "an", "the", "to", "for", "saying", "with", "about", "what", "which", "who", "whom", "whose", "where", "when", "why", "how", "all", "any", "some",
)

MARKS = "\"'“”"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


class Pieces:
    """A task in pieces. Readers take columns of places and give columns of places or texts."""

    def __init__(self, task: Column) -> None:
        raw = F.regexp_extract_all(F.trim(drop_bracketed(F.coalesce(task, F.lit("")))), F.lit(rf"[{MARKS}][^{MARKS}]+[{MARKS}]\s*|\S+\s*"), F.lit(0))
        told = F.transform(raw, lambda x: F.struct(x.alias("raw"), F.lower(F.regexp_replace(x, r"^\W+|\s+\z", "")).alias("word"), F.rlike(x, F.lit(rf"^[{MARKS}][^{MARKS}]+[{MARKS}]\s*\z")).alias("quoted")))
        self.all = told

    def over(self, read: Callable[[Pieces, Column], Column]) -> Column:
        """What the reader makes of the pieces, which are cut once for all that it asks of them."""
        inner = Pieces.__new__(Pieces)

        def body(held: Column) -> Column:
            inner.all = held
            return read(inner, F.size(held))

        return let(self.all, body)

    def word(self, at: Column) -> Column:
        return F.coalesce(F.get(self.all, at)["word"], F.lit(""))

    def raw(self, at: Column) -> Column:
        return F.coalesce(strip(F.get(self.all, at)["raw"]), F.lit(""))

    def quoted(self, at: Column) -> Column:
        return F.coalesce(F.get(self.all, at)["quoted"], F.lit(False))

    def after(self, at: Column, *words: str) -> Column:
        """The place after a piece that is one of the words, else the place itself."""
        return at + F.when(self.word(at).isin(*words), 1).otherwise(0)

    def text(self, start: Column, end: Column) -> Column:
        """The pieces from start up to end as they stand; null if there is nothing."""
        own = strip(F.array_join(F.transform(F.slice(self.all, start + 1, F.greatest(end - start, F.lit(0))), lambda x: x["raw"]), ""))
        return let(own, lambda x: F.when(x != "", x))

    def places(self, start: Column | int = 0) -> Column:
        n = F.size(self.all)
        start = F.lit(start) if isinstance(start, int) else start
        return F.when(start < n, F.sequence(start, n - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def first(self, start: Column, test: Callable[[Column], Column], otherwise: Column | None = None) -> Column:
        """The first place from start on that passes."""
        found = F.get(F.filter(self.places(start), test), F.lit(0))
        return found if otherwise is None else F.coalesce(found, otherwise)

    def first_reading(self, read: Callable[[Column], Column]) -> Column:
        """The reading that is not null of the leftmost place."""
        return F.get(F.filter(F.transform(self.places(), read), lambda x: x.isNotNull()), F.lit(0))


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{MARKS} ]+|[{MARKS} ]+\z", "")


def contact_name(name: Column) -> Column:
    """Whether a text can be a contact's name: not empty, no number or ordinal, none of NO_NAMES."""
    clean = unquoted(F.coalesce(name, F.lit("")))
    return (clean != "") & ~F.rlike(clean, F.lit(r"(?i)^[0-9]+(?:st|nd|rd|th)?\z")) & ~F.lower(clean).isin(*NO_NAMES)


def _pair(contact: Column, body: Column) -> Column:
    return let(F.struct(contact.alias("contact"), body.alias("body")), lambda x: F.when(x["contact"].isNotNull() & x["body"].isNotNull(), x))


def _recipients(p: Pieces, n: Column) -> list[Callable[[Column], Column]]:
    """Readers of a message to a contact at a verb's place, the most telling first."""
    verb = lambda i: p.word(i).isin(*SEND)
    plain = lambda i: F.rlike(p.raw(i), F.lit(r"^[A-Za-z0-9_]+\z"))
    proper = lambda i: F.rlike(p.raw(i), F.lit(r"^[A-Z][a-z0-9_]+\z"))
    rest = lambda i: p.text(i, n)
    one_of = lambda i, *words: p.word(i).isin(*words)

    def found_first(i: Column) -> Column:
        """Look a contact up, and then write to them."""
        who = F.when(p.word(i) == "find", i + 1).when(p.word(i) == "search", p.after(p.after(i + 1, "for"), "contact"))

        def met(at: Column) -> Column:
            said = lambda k: p.after(p.after(k + 2, *PRONOUNS), *SAYING)
            return let(p.first(at + 1, lambda k: (p.word(k) == "and") & verb(k + 1)), lambda link: F.when(link.isNotNull(), _pair(unquoted(p.text(at, link)), let(said(link), rest))))

        return F.when(p.word(i).isin("find", "search"), let(who, met))

    def addressed(i: Column) -> Column:
        """Send a message to someone, saying something."""

        def met(thing: Column) -> Column:
            link = F.when((p.word(thing) == "message") & (p.word(thing + 1) == "to"), p.first(thing + 3, lambda k: one_of(k, *SAYING)))
            return let(link, lambda k: F.when(k.isNotNull(), _pair(unquoted(p.text(thing + 2, k)), rest(k + 1))))

        return F.when(p.word(i) == "send", let(p.after(i + 1, "a"), met))

    def in_quotes(i: Column) -> Column:
        """The recipient in quotation marks; what joins it to the message is left out only where it is whole."""
        said = i + 2
        body = let(p.after(p.after(said, "a"), *QUOTED_THINGS), lambda thing: F.when(one_of(thing, *SAYING, "say", "to"), rest(thing + 1)).otherwise(rest(p.after(said, "a", *SAYING))))
        return F.when(verb(i) & p.quoted(i + 1), _pair(unquoted(p.raw(i + 1)), F.coalesce(body, rest(said))))

    def two_names(i: Column) -> Column:
        """First name and surname, both written as names."""
        said = i + 3
        return F.when(p.raw(i).isin(*SEND) & proper(i + 1) & proper(i + 2), _pair(p.text(i + 1, i + 3), F.coalesce(rest(p.after(said, "a", *SAYING)), rest(said))))

    def named_thing(i: Column) -> Column:
        """One name, and then what is sent, or what it says."""
        said = i + 2
        body = F.when(one_of(said, *SAYING), rest(said + 1)).otherwise(let(p.after(said, "a"), lambda thing: F.when(one_of(thing, *THINGS), F.coalesce(rest(p.after(thing + 1, *SAYING)), rest(thing + 1)))))
        return F.when(verb(i) & plain(i + 1), _pair(p.raw(i + 1), body))

    def some_thing(i: Column) -> Column:
        return F.when(verb(i) & plain(i + 1) & one_of(i + 2, "a", "an"), _pair(p.raw(i + 1), rest(i + 3)))

    def speech(i: Column) -> Column:
        """One name, and then words that a sentence begins with."""
        opens = F.lower(F.regexp_extract(p.raw(i + 2), r"^(\w+)", 1)).isin(*OPENERS)
        return F.when(verb(i) & plain(i + 1) & opens, _pair(p.raw(i + 1), rest(i + 2)))

    def whatever(i: Column) -> Column:
        return F.when(verb(i) & plain(i + 1), _pair(p.raw(i + 1), rest(i + 2)))

    return [found_first, addressed, in_quotes, two_names, named_thing, some_thing, speech, whatever]


def contact_task(task: Column) -> Column:
    """struct<contact, body>: whom a task sends a message, and what. Of each reader the leftmost reading counts, and of the readers the first whose reading names a contact."""

    def read(p: Pieces, n: Column) -> Column:
        # a reader is asked only if none before it names a contact
        return F.coalesce(*[let(p.first_reading(reader), lambda x: F.when(x.isNotNull() & contact_name(x["contact"]), x)) for reader in _recipients(p, n)])

    # most texts hold no verb of sending at all
    return F.when(F.rlike(F.coalesce(task, F.lit("")), F.lit(rf"(?i)(?:{'|'.join(SEND)})")), Pieces(task).over(read))


def search_query(task: Column, named: Column | None = None) -> Column:
    """What a search task looks for; null for messages to contacts. named: contact_task() of the task, where it is at hand.

    After the verb comes a quoted query, or one that a second action follows, or the rest; the site and politeness at its end go.
    """

    def read(p: Pieces, n: Column) -> Column:
        asked = lambda i: F.when(p.word(i) == "search", p.after(i + 1, "for")).when(p.word(i).isin("find", "lookup"), i + 1).when((p.word(i) == "look") & (p.word(i + 1) == "up"), i + 2)
        last = lambda i, k: F.lower(F.regexp_replace(p.raw(i - k), r"\W+\z", ""))

        def bare(start: Column, end: Column) -> Column:
            def without_site(k: Column) -> Column:
                site = (k - start > 2) & last(k, 2).isin("on", "in") & (last(k, 1).isin(*SITES) | F.rlike(p.raw(k - 1), F.lit(r"^\w+\.\w+\z")))
                return k - F.when(site, 2).otherwise(0)

            def without_please(k: Column) -> Column:
                return k - F.when((k - start > 1) & (p.word(k - 1) == "please"), 1).when((k - start > 2) & (p.word(k - 2) == "for") & p.word(k - 1).isin("me", "us"), 2).otherwise(0)

            return let(let(end, without_site), lambda k: p.text(start, without_please(k)))

        def compound(i: Column) -> Column:
            def met(start: Column) -> Column:
                link = p.first(start + 1, lambda k: (p.word(k) == "and") & F.rlike(p.word(k + 1), F.lit(f"^(?:{'|'.join(LOOK)})")))
                return let(link, lambda k: F.when(k.isNotNull(), bare(start, k)))

            return let(asked(i), lambda start: F.when(start.isNotNull(), met(start)))

        def in_quotes(i: Column) -> Column:
            content = lambda at: F.trim(F.regexp_replace(p.raw(at), f"[{MARKS}]", ""))
            return let(asked(i), lambda at: F.when(p.quoted(at), F.trim(F.regexp_replace(content(at), r"(?i)\s+(?:for\s+(?:me|us)|please)\z", ""))))

        simple = lambda i: let(asked(i), lambda start: F.when(start.isNotNull(), bare(start, n)))
        return F.coalesce(*[p.first_reading(reader) for reader in (in_quotes, compound, simple)])

    query = F.when(F.rlike(F.coalesce(task, F.lit("")), F.lit(r"(?i)search|find|look\s*up")), Pieces(task).over(read))
    return F.when((contact_task(task) if named is None else named).isNull(), query)


def told_text(task: Column) -> Column:
    """The words that a task wants sent to no named contact: in quotes, else after saying, else after say, type or write, else after message that."""

    def read(p: Pieces, n: Column) -> Column:
        def said(start: Column, end: Column) -> Column:
            """Up to where it says how to send it."""
            return p.text(start, F.least(end, p.first(start + 1, lambda k: (p.word(k) == "and") & F.rlike(p.word(k + 1), F.lit(f"^(?:{'|'.join(SUBMIT)})")), n)))

        def content(i: Column) -> Column:
            text = F.trim(F.regexp_replace(p.raw(i), f"[{MARKS}]", ""))
            return F.when(p.quoted(i) & ~F.rlike(p.raw(i), F.lit("[“”]")), F.struct(text.alias("v"), p.word(i - 1).isin(*SEND).alias("whom")))

        def typed(i: Column) -> Column:
            where = p.first(i + 2, lambda k: p.word(k).isin("in", "into", "to", "on") & (k < n - 1), n)
            return F.when(p.word(i).isin("say", "type", "write"), said(i + 1, where))

        quote = let(p.first_reading(content), lambda x: F.when(~x["whom"], x["v"]))
        saying = p.first_reading(lambda i: F.when(p.word(i) == "saying", said(i + 1, n)))
        that = p.first_reading(lambda i: F.when((p.word(i) == "message") & (p.word(i + 1) == "that"), said(i + 2, n)))
        return F.coalesce(quote, saying, p.first_reading(typed), that)

    return Pieces(task).over(read)


def journey(task: Column) -> Column:
    """struct<from_station, to_station, date> that a task names: from one place to another, else each on its own; a date after on or date."""

    def read(p: Pieces, n: Column) -> Column:
        plain = lambda i: F.rlike(p.raw(i), F.lit(r"^[A-Za-z0-9/]+\z"))

        def place(start: Column, *stops: str) -> tuple[Column, Column]:
            """(name, its end): the plain words up to a stop word or the end."""
            end = p.first(start + 1, lambda k: p.word(k).isin(*stops), n)
            fits = F.forall(F.when(start < end, F.sequence(start, end - 1)).otherwise(F.expr("cast(array() as array<int>)")), plain)
            return F.when(fits, p.text(start, end)), end

        def both(i: Column) -> Column:
            start, middle = place(i + 1, "to")
            end, _ = place(middle + 1, "on", "for", "at", "date")
            return F.when((p.word(i) == "from") & (middle < n) & start.isNotNull() & end.isNotNull(), F.struct(start.alias("a"), end.alias("b")))

        alone = lambda word, *stops: p.first_reading(lambda i: F.when(p.word(i) == word, place(i + 1, *stops)[0]))
        day = p.first_reading(
            lambda i: F.when(p.word(i).isin("on", "date"), F.coalesce(F.nullif(F.regexp_extract(p.raw(i + 1), r"^[0-9/\-]+", 0), F.lit("")), F.nullif(F.regexp_extract(p.raw(i + 1), r"^(?i)(?:tomorrow|today)", 0), F.lit(""))))
        )
        pair = p.first_reading(both)
        start, end = F.coalesce(pair["a"], alone("from", "to", "on", "date", "in", "tomorrow", "today")), F.coalesce(pair["b"], alone("to", "from", "on", "date", "in", "tomorrow", "today"))
        return F.struct(start.alias("from_station"), end.alias("to_station"), day.alias("date"))

    return Pieces(task).over(read)


def without_command(task: Column, verbs: Sequence[str] = ("send", "message", "type", "write", "tell")) -> Column:
    """struct<bare, rest> in lower case: the task without its verb (and him, her or them), and that without a quoted name and what joins it."""

    def read(p: Pieces, n: Column) -> Column:
        start = F.when((n > 1) & p.word(F.lit(0)).isin(*verbs), p.after(F.lit(1), *PRONOUNS)).otherwise(F.lit(0))
        text = lambda i: F.coalesce(F.lower(p.text(i, n)), F.lit(""))

        def both(start: Column) -> Column:
            rest = F.when(p.quoted(start), p.after(start + 1, "a", "an", *SAYING)).otherwise(start)
            return F.struct(text(start).alias("bare"), let(rest, text).alias("rest"))

        return let(let(start, lambda at: F.when(at < n, at).otherwise(F.lit(1))), both)

    return Pieces(task).over(read)
