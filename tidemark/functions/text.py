"""Text functions as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text) -> Column:
    """Lower-cased runs of letters and digits: the engine's tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"))


def split_words(text) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def normalise_space(text) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalise_for_validation(text) -> Column:
    """White space to one space, marks dropped, lower case: what n-gram validation compares."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_ ]", "")
    return F.lower(F.trim(F.regexp_replace(x, " +", " ")))


def query_terms(query) -> Column:
    """Terms of a query: words keep letters, digits, hyphens and dots, then are cut into tokens."""
    kept = F.filter(F.transform(split_words(query), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}.\-]", "")), lambda w: w != "")
    return F.array_distinct(tokens(F.array_join(kept, " ")))


def section_id(heading) -> Column:
    """`3.1.2. Name` gives 3.1.2; a heading without a number is its own id."""
    number = F.regexp_extract(F.trim(heading), r"^([\d.]+)\.?\s+.+$", 1)
    return F.when(F.rtrim(number, F.lit(".")) != "", F.rtrim(number, F.lit("."))).otherwise(F.trim(heading))


def section_level(heading) -> Column:
    number = F.rtrim(F.regexp_extract(F.trim(heading), r"^([\d.]+)\.?\s+.+$", 1), F.lit("."))
    return F.when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."))) + 1).otherwise(1)


def parent_id(dotted) -> Column:
    """1.2 of 1.2.3; null at the top."""
    return F.when(F.contains(dotted, F.lit(".")), F.regexp_replace(dotted, r"\.[^.]+$", ""))


def stem(name) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def extension(name) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def human_size(n) -> Column:
    """512B, 1.5KB, 2.0MB, 3.4GB: one digit after the point, ties to even."""
    one = lambda k, unit: F.concat(F.format_string("%.1f", F.bround(n / (1024**k), 1)), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit("B"))).when(n < 1024**2, one(1, "KB")).when(n < 1024**3, one(2, "MB")).otherwise(one(3, "GB"))


def short_title(text, most: int = 40) -> Column:
    x = normalise_space(text)
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def chunk_header(title, doc_type, section, form=None, hierarchy=None, document=None) -> Column:
    """One line for each part that is there, then `---`."""
    parts = {"Document": document, "Title": title, "Type": doc_type, "Form": form, "Hierarchy": hierarchy, "Section": section}
    line = lambda name, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{name}: "), x))
    return F.concat_ws("\n", *[line(k, x) for k, x in parts.items() if x is not None], F.lit("---"))


#: Kinds of references in order, their labels, and how many of each are named (fixed values).
REFERENCES = {"forms": ("FORMS", 5), "regulations": ("REGS", 3), "procedures": ("PROCS", 3), "policies": ("POLICIES", 3), "reports": ("REPORTS", 3), "chapters": ("CHAPTERS", 3), "sections": ("SECTIONS", 5)}


def references_line(**kinds) -> Column:
    """`FORMS: a, b| REGS: c| PROCS: d` and so on, of arrays of names for some of REFERENCES."""
    parts = [F.when(F.size(kinds[k]) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(kinds[k], 1, n), ", "))) for k, (label, n) in REFERENCES.items() if k in kinds]
    return F.concat_ws("| ", *parts)


def section_prefix(name) -> Column:
    """The number or letter that a section's name begins with (3, 3.1.2, `A.` before a word); null without one."""
    x = F.regexp_extract(F.trim(name), r"^([0-9]+(?:\.[0-9]+)*|[A-Z]\.)\b", 1)
    return F.when(x != "", x)


def anchor(first_sentence, summary, title) -> Column:
    """What shows that a section begins here: its first sentence, else its summary, else its title without the number or the
    letter and dot before it, if that leaves two words at least; up to 200 characters."""
    rest = F.trim(F.regexp_extract(title, r"^\s*(?:[0-9]+(?:\.[0-9]+)*|[A-Z]\.)\s*(.*)$", 1))
    bare = F.coalesce(F.nullif(rest, F.lit("")), F.trim(title))
    said = F.coalesce(F.nullif(first_sentence, F.lit("")), F.nullif(summary, F.lit("")))
    named = F.when(F.size(split_words(bare)) >= 2, F.substring(bare, 1, 200))
    return F.when(said.isNotNull(), F.nullif(F.substring(F.trim(said), 1, 200), F.lit(""))).otherwise(named)


def limit_repeats(lines: Column, most: int = 3, intended: bool = True) -> Column:
    """An array of lines in which a run of equal ones keeps `most`. The rule that documents were prepared by counts anew from the line
    at which it would cut, and so keeps all: `intended` False does that."""
    if not intended:
        return lines

    before = [F.concat(F.array_repeat(F.lit(None).cast("string"), k), lines).alias(f"b{k}") for k in range(1, most + 1)]

    def keep(r):
        other = F.lit(False)
        for k in range(1, most + 1):
            other = other | ~r["x"].eqNullSafe(r[f"b{k}"])
        return r["x"].isNotNull() & other

    return F.transform(F.filter(F.arrays_zip(lines.alias("x"), *before), keep), lambda r: r["x"])


def markdown_rows(text) -> Column:
    """Tables repaired: in lines that begin with a bar, a cell that is a separator of four hyphens or more becomes three (colons
    stay), and in a cell of over 200 characters runs of over 50 equal ones become three. Other lines stay as they are."""

    def cell(x):
        bare = F.regexp_replace(x, r"^\s+|\s+$", "")
        sep = F.concat(F.lit(" "), F.regexp_replace(bare, r"^(:?)-{4,}(:?)$", "$1---$2"), F.lit(" "))
        short = F.regexp_replace(bare, r"(.)\1{50,}", "$1$1$1")
        long = (F.length(bare) > 200) & (F.length(short) < F.length(bare))
        return F.when(F.regexp_like(bare, F.lit(r"^:?-{4,}:?$")), sep).when(long, F.concat(F.lit(" "), short, F.lit(" "))).otherwise(x)

    line = lambda x: F.when(F.regexp_like(x, F.lit(r"^\s*\|")), F.array_join(F.transform(F.split(x, r"\|", -1), cell), "|")).otherwise(x)
    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def form_title(code, title) -> Column:
    """`code - title`, unless the title's part before a hyphen begins with the code, spaces and case aside."""
    bare = lambda x: F.upper(F.replace(x, F.lit(" ")))
    head = bare(F.trim(F.substring_index(title, "-", 1)))
    return F.when(F.coalesce(code, F.lit("")) == "", title).when(F.startswith(head, bare(code)), title).otherwise(F.concat(code, F.lit(" - "), title))


def safe_name(name) -> Column:
    """A path's last part; null for none and for names that begin with a dot."""
    base = F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    return F.when((base != "") & ~F.startswith(base, F.lit(".")), base)


def iso_time(seconds) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def cosine(a, b, none: bool = False) -> Column:
    """Cosine of two arrays, 0 where one has no length, or null with `none`."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    out = dot / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return out if none else F.coalesce(out, F.lit(0.0))


def parse_json_reply(text) -> Column:
    """The object in a model's reply, without fences, from the first to the last brace; only if that does not parse, with control
    characters as spaces and without commas before a closing bracket; null if it still does not parse."""
    x = F.regexp_extract(F.regexp_replace(text, r"```(json)?", ""), r"(?s)(\{.*\})", 1)
    mended = F.regexp_replace(F.regexp_replace(x, r"[\x00-\x1F]+", " "), r",\s*([}\]])", "$1")
    return F.when(F.try_parse_json(x).isNotNull(), x).when(F.try_parse_json(mended).isNotNull(), mended)


#: Keys of a stored payload that are the engine's own (fixed values).
INTERNAL = ["_node_content", "_node_type", "document_id", "doc_id", "ref_doc_id"]


def own_metadata(payload) -> Column:
    """A payload map without the engine's own keys."""
    return F.map_filter(payload, lambda k, _: ~k.isin(*INTERNAL))


def payload_text(payload) -> Column:
    """The text in a payload's JSON content, else its text, else its document, else nothing."""
    there = lambda x: F.nullif(x, F.lit(""))
    at = lambda k: F.try_element_at(payload, F.lit(k))
    return F.coalesce(there(F.get_json_object(at("_node_content"), "$.text")), there(at("text")), there(at("document")), F.lit(""))


def node_metadata(raw, doc_id, section_id) -> Column:
    """A stored JSON text as a map of texts; source and section_id are filled in where it lacks them."""
    got = F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))
    for key, value in (("source", doc_id), ("section_id", section_id)):
        missing = ~F.map_contains_key(got, F.lit(key))
        got = F.when(missing, F.map_concat(got, F.create_map(F.lit(key), value))).otherwise(got)
    return got


def kept_sections(sections) -> Column:
    """Of an array of (name, content) those with a name and some content."""
    return F.filter(sections, lambda s: s["name"].isNotNull() & (F.trim(F.coalesce(s["content"], F.lit(""))) != ""))


def base_metadata(topic, title, hierarchy, sections) -> Column:
    """topic (the title without one), hierarchy joined by ` > `, names of the sections."""
    return F.struct(
        F.coalesce(F.nullif(topic, F.lit("")), title).alias("topic"),
        F.array_join(hierarchy, " > ").alias("hierarchy"),
        F.array_join(F.transform(sections, lambda s: s["name"]), ", ").alias("sections"),
    )


def upload_title(name) -> Column:
    return F.initcap(F.replace(stem(name), F.lit("_"), F.lit(" ")))


def has_table(text) -> Column:
    """Whether a text holds a Markdown table: two lines or more that begin with a bar, one of them a separator."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.startswith(F.trim(x), F.lit("|")))
    return (F.size(rows) >= 2) & F.exists(rows, lambda x: F.regexp_like(x, F.lit(r"^\s*\|[\s:|-]*-{3,}[\s:|-]*$")))


def answer_block(label, text, regulatory) -> Column:
    """A part of an answer for the prompt that joins them, marked if it comes from a standard."""
    tag = F.when(regulatory, " (REGULATORY STANDARD)").otherwise("")
    return F.concat(F.lit("--- "), label, tag, F.lit(" ---\n"), text)


def without_header(text) -> Column:
    """A chunk's text after the header that ends in `---`, if it has one."""
    return F.when(F.contains(text, F.lit("\n---\n")), F.regexp_replace(text, r"(?s)^.*?\n---\n", "")).otherwise(text)
