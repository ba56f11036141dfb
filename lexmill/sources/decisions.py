"""From raw payloads to records: two kinds of documents as projections over the values that ``markup.leaves`` reads out of them.

A record is one row with its scalars, its court and arrays of documents, parties and citations; ``children`` turns an array into the
rows of a child table. Nothing looks outside its own row but the look-up of courts, which is a join with the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.hashing import fingerprint
from lexmill.sources import markup

# Shapes of identifiers that may be asked for.
ECLI = r"\AECLI:[A-Z]{2}:[A-Za-z0-9]{1,10}:[0-9]{4}:[A-Za-z0-9.\-]{1,30}\z"
# Body elements and the kind of document that they make.
BODIES = {"uitspraak": "judgment", "conclusie": "opinion"}
# Elements of a work that carry subject labels, in order.
SUBJECTS = ("RESOURCE_LEGAL_IS_ABOUT_SUBJECT-MATTER", "CASE-LAW_IS-ABOUT_CASE-LAW-SUBJECT-MATTER", "CASE-LAW_IS_ABOUT_CONCEPT", "CASE-LAW_IS_ABOUT_CONCEPT_NEW_CASE-LAW", "IS_ABOUT")
# Metadata names and where in a work they stand.
NOTICE_METADATA = {
    "celex": "RESOURCE_LEGAL_ID_CELEX/VALUE", "ecli": "ECLI/VALUE", "cellar_uri": "URI/VALUE", "cellar_identifier": "URI/IDENTIFIER", "resource_type": "WORK_HAS_RESOURCE-TYPE/URI/IDENTIFIER",
    "resource_type_label": "WORK_HAS_RESOURCE-TYPE/PREFLABEL", "celex_type": "RESOURCE_LEGAL_TYPE/VALUE", "court_formation": "CASE-LAW_DELIVERED_BY_COURT-FORMATION/PREFLABEL",
    "procedure_code": "CASE-LAW_HAS_TYPE_PROCEDURE_CONCEPT_TYPE_PROCEDURE/URI/IDENTIFIER", "originates_in_country": "CASE-LAW_ORIGINATES_IN_COUNTRY/PREFLABEL",
    "appealed_in_case": "CASE-LAW_SUBJECT_TO_APPEAL_IN_CASE_COURT/SAMEAS/URI/IDENTIFIER", "national_judgement": "CASE-LAW_NATIONAL-JUDGEMENT/VALUE",
    "date_request_opinion": "RESOURCE_LEGAL_DATE_REQUEST_OPINION/VALUE", "date_creation_legacy": "DATE_CREATION_LEGACY/VALUE", "cellar_creation_date": "CREATIONDATE/VALUE",
    "cellar_last_modification_date": "LASTMODIFICATIONDATE/VALUE", "work_version": "VERSION/VALUE", "published_in_reports": "CASE-LAW_PUBLISHED_IN_ERECUEIL/VALUE",
}


def requestable(identifier: Column) -> Column:
    """Whether an identifier is one that may be sent to the source."""
    return F.coalesce(identifier.rlike(ECLI), F.lit(False))


def all_values(facts: Column, name: str, path: str = "", block: int = 0) -> Column:
    return F.transform(F.filter(facts, lambda f: (f["block"] == block) & (f["name"] == name) & (f["path"] == path)), lambda f: f["value"])


def value(facts: Column, name: str, path: str = "", block: int = 0) -> Column:
    """The first one, or null."""
    return F.get(all_values(facts, name, path, block), F.lit(0))


def _joined(values: Column, separator: str) -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, separator))


# ---- decisions ------------------------------------------------------------------------------------------------------


#: Rows of the court vocabulary (some 200 bytes each) that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000


def court_vocabulary(payloads: DataFrame, payload: str = "payload", order: str | None = None) -> DataFrame:
    """(source_identifier, name, abbreviation, source_type, level, domain) of each court that vocabularies list; entries without an
    identifier are left out. Of several with one identifier the last stays: by ``order``, a column of the payloads (without one by their
    digests), then by place."""
    read = payloads.select(F.struct(*([order] if order else []), F.md5(payload)).alias("list"), markup.leaves(F.col(payload)).alias("f"))
    facts = read.select("list", F.inline("f")).where("name = 'Instantie'")
    of = lambda name: F.max(F.when(F.col("path") == name, F.col("value")))
    rows = facts.groupBy("list", "item").agg(of("Identifier").alias("source_identifier"), of("Naam").alias("name"), of("Afkorting").alias("abbreviation"), of("Type").alias("source_type")).where("source_identifier IS NOT NULL")
    last = rows.groupBy("source_identifier").agg(F.max_by(F.struct("name", "abbreviation", "source_type"), F.struct("list", "item")).alias("r"))
    rated = markup.court(F.col("r.source_type"))
    return last.select("source_identifier", F.coalesce("r.name", "source_identifier").alias("name"), "r.abbreviation", "r.source_type", rated["level"].alias("level"), rated["domain"].alias("domain"))


def decisions(raw: DataFrame, courts: DataFrame) -> DataFrame:
    """Records of decision payloads. raw: (source_id, title, source_url, payload) as found; courts: the vocabulary.

    A payload that cannot be read, or has no description, gives no record. A decision without a body keeps a document of kind other
    without text. A court that the vocabulary doesn't know has its name alone. Each payload is read once, and no text moves: the
    vocabulary, a row for each court, goes to the records as long as it is small.
    """
    parsed = raw.withColumn("p", markup.decision(F.col("payload"), tuple(BODIES), "inhoudsindicatie")).where("p IS NOT NULL AND size(p.facts) > 0")
    read = parsed.select("*", "p.*").withColumnRenamed("facts", "f").withColumnRenamed("properties", "props").drop("payload", "p")
    read = read.withColumns({"subjects": all_values(F.col("f"), "subject"), "creator": F.coalesce(value(F.col("f"), "creator", "@resourceIdentifier"), F.concat(F.lit("instantie/"), value(F.col("f"), "creator")))})
    f = F.col("f")
    law = markup.law_domain(F.col("subjects"))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BODIES.items() for x in kv]), F.col("body")), F.lit("other"))
    document = F.struct(kind.alias("doc_type"), F.coalesce("body_language", value(f, "language")).alias("language"), F.lit("xml").alias("format"), F.when(F.col("body").isNotNull(), F.col("text")).alias("full_text"))
    rows = read.select(
        F.lit("NL").alias("jurisdiction_code"), F.coalesce(value(f, "identifier"), "source_id").alias("source_id"), F.coalesce(value(f, "title", block=1), "title").alias("title"), "abstract",
        _joined(F.col("subjects"), "; ").alias("subject"), markup.date_prefix(value(f, "date")).alias("decision_date"), F.lit(None).cast("date").alias("filing_date"),
        markup.date_prefix(value(f, "issued")).alias("publication_date"), all_values(f, "zaaknummer").alias("case_numbers"), value(f, "language").alias("language"),
        law["domain"].alias("law_domain"), law["subfield"].alias("law_subfield"), value(f, "procedure").alias("procedure_type"), F.lit(None).cast("string").alias("outcome"),
        F.coalesce("source_url", value(f, "identifier", block=1)).alias("source_url"), F.col("creator").alias("court_identifier"), value(f, "creator").alias("creator_name"),
        F.array(document).alias("documents"), F.array().cast("array<struct<name: string, role: string, ordinal: int>>").alias("parties"), markup.citations(F.col("props")).alias("citations"),
        F.to_json(F.map_from_entries(F.transform(F.array_distinct(F.transform("f", lambda x: x["name"])), lambda n: F.struct(n, F.transform(F.filter("f", lambda x: (x["name"] == n) & (x["path"] == "")), lambda x: x["value"]))))).alias("source_metadata"),
    )
    known = courts.select(F.col("source_identifier").alias("court_identifier"), F.struct("name", "level", "domain").alias("c"))
    known = F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known
    joined = rows.join(known, "court_identifier", "left")
    court = F.struct(F.coalesce("c.name", "creator_name", "court_identifier").alias("name"), F.col("c.level").alias("level"), F.col("c.domain").alias("domain"))
    return joined.withColumn("court", F.when(F.col("court_identifier").isNotNull(), court)).drop("c", "creator_name")


# ---- notices --------------------------------------------------------------------------------------------------------


def notice_facts(raw: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """raw (source_id, title, payload, and notice_url if known) with ``notice``, which tells notices of one id apart, ``f``, the values of each
    notice's own work and none of the works that it embeds, and more that is read with them: ``decoding``, ``firsts``, ``cited`` and ``numbers``.
    A payload that cannot be read gives no row. With ``names`` only the elements of these names are read out."""
    key = F.md5(F.concat(F.coalesce("source_id", F.lit("")), F.lit("\0"), F.coalesce("payload", F.lit(""))))
    read = raw.withColumns({"notice": key, "n": markup.notice(F.col("payload"), frozenset(names) if names is not None else None)}).where("n.some")
    return read.select(*raw.columns, "notice", F.col("n.facts").alias("f"), "n.decoding", F.col("n.first").alias("firsts"), F.col("n.citations").alias("cited"), "n.numbers")


def labels(f: Column, *names: str) -> Column:
    """Distinct preferred labels at any depth below the named elements, in the order of the names."""
    of = lambda name: F.transform(F.filter(f, lambda x: (x["name"] == name) & x["path"].rlike(r"(\A|/)PREFLABEL\z")), lambda x: x["value"])
    return F.array_distinct(F.concat(*map(of, names)))


def codes(f: Column, name: str) -> Column:
    """Distinct vocabulary codes at any depth below the named elements, in the notice's order."""
    return F.array_distinct(F.transform(F.filter(f, lambda x: (x["name"] == name) & x["path"].rlike(r"(\A|/)OP-CODE\z")), lambda x: x["value"]))


def languages(f: Column) -> Column:
    """Codes of the languages in which a work exists: three letters after the last point of an expression's identifiers, sorted."""
    suffix = F.transform(F.filter(f, lambda x: (x["name"] == "WORK_HAS_EXPRESSION") & (x["path"] == "SAMEAS/URI/IDENTIFIER")), lambda x: F.upper(F.regexp_extract(x["value"], r"\.([A-Za-z]{3})\z", 1)))
    return F.array_sort(F.array_distinct(F.filter(suffix, lambda s: s != "")))


def procedure_language(f: Column) -> Column:
    return F.upper(F.coalesce(value(f, "CASE-LAW_USES_PROCEDURE_LANGUAGE", "URI/IDENTIFIER"), value(f, "CASE-LAW_USES_PROCEDURE_LANGUAGE", "IDENTIFIER")))


#: Elements that tell in which languages a work exists and was made.
LANGUAGE_NAMES = ("WORK_HAS_EXPRESSION", "CASE-LAW_USES_PROCEDURE_LANGUAGE")


def language_plan(available: Column, procedural: Column, preferred: tuple[str, ...] = ("ENG",)) -> Column:
    """struct<preferred, fallbacks array<struct<language, reason>>>: of the wanted languages those that exist, all to be fetched; and what
    to try if none of them can be: the language of the procedure, then the first other one."""
    wanted = F.array_intersect(F.array(*map(F.lit, preferred)), available)
    by_procedure = F.filter(F.array(procedural), lambda x: x.isNotNull() & F.array_contains(available, x) & ~F.array_contains(wanted, x))
    other = F.slice(F.array_except(F.array_except(available, wanted), by_procedure), 1, 1)
    why = lambda codes, reason: F.transform(codes, lambda x: F.struct(x.alias("language"), F.lit(reason).alias("reason")))
    return F.struct(wanted.alias("preferred"), F.concat(why(by_procedure, "procedural"), why(other, "only_available")).alias("fallbacks"))


def notice_citations(facts: DataFrame) -> DataFrame:
    """(notice, source_id, target, citation_type, scheme, position): by CELEX number, else by ECLI; the first of each target and relation. Notices
    are told apart by ``notice``, so two of one id keep their own citations. They are found while a notice is read, so one short row of each
    notice is shuffled, to tell equal ones."""
    distinct = facts.where("size(cited) > 0").select("notice", "source_id", "cited").repartition("notice").distinct()
    return distinct.select("notice", "source_id", F.inline("cited")).select("notice", "source_id", "target", "citation_type", "scheme", "position")


def _with(table: DataFrame, **defaults: str) -> DataFrame:
    """``table`` with null columns of these types where it lacks them."""
    return table.withColumns({c: F.lit(None).cast(kind) for c, kind in defaults.items() if c not in table.columns})


def notices(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Records of notices. texts: (source_id, language, payload) of the fetched versions, languages by their three-letter codes, and, where
    known, format, selected_as and source_url (see ``fetch.versions``).

    The notice itself is a document without text; the record's language is that of its first text, else of the procedure. Equal notices
    of one id give equal records.
    """
    facts = _with(facts, notice_url="string", decoding="string")
    texts = _with(texts, format="string", selected_as="string", source_url="string").where("language IS NOT NULL")
    first_of = lambda place: F.try_element_at("firsts", F.lit(place))
    title = F.coalesce("title", first_of("EXPRESSION_TITLE/VALUE"))
    version = F.struct(markup.language(F.col("language")).alias("language"), F.coalesce("format", F.lit("html")).alias("format"), markup.reading_text(F.col("payload")).alias("full_text"), F.col("language").alias("code"), "selected_as", "source_url")
    versions = texts.select("source_id", version.alias("d")).groupBy("source_id").agg(F.array_sort(F.collect_list("d")).alias("versions"))
    # all that a notice says is taken out of its facts before it meets its texts, so that no facts are shuffled
    f = F.col("f")
    few = facts.withColumn("f", F.filter(f, lambda x: x["name"].isin(*SUBJECTS, *LANGUAGE_NAMES, "WORK_CREATED_BY_AGENT")))
    few = few.withColumn("agent", F.get(F.filter(f, lambda x: (x["name"] == "WORK_CREATED_BY_AGENT") & (x["path"] == "URI/TYPE") & (x["value"] == "corporate-body")), F.lit(0))["item"])
    few = few.withColumn("agents", F.filter(f, lambda x: (x["item"] == F.col("agent")) & (x["name"] == "WORK_CREATED_BY_AGENT")))
    of_agent = lambda path: F.get(F.transform(F.filter("agents", lambda x: x["path"] == path), lambda x: x["value"]), F.lit(0))
    said = few.select(
        "source_id", title.alias("title"), markup.document_kind(first_of("WORK_HAS_RESOURCE-TYPE/URI/IDENTIFIER")).alias("kind"), markup.date_prefix(first_of("WORK_DATE_DOCUMENT/VALUE")).alias("decision_date"),
        markup.date_prefix(F.coalesce(first_of("CREATIONDATE/VALUE"), first_of("DATE_CREATION_LEGACY/VALUE"))).alias("publication_date"), markup.case_numbers(F.col("numbers")).alias("case_numbers"),
        *[labels(f, name).alias(f"labels_{i}") for i, name in enumerate(SUBJECTS)], codes(f, "CASE-LAW_IS_ABOUT_CONCEPT").alias("directory_codes"), languages(f).alias("have"), procedure_language(f).alias("own"),
        first_of("CASE-LAW_HAS_TYPE_PROCEDURE_CONCEPT_TYPE_PROCEDURE/PREFLABEL").alias("procedure_type"), F.coalesce(of_agent("URI/VALUE"), F.concat(F.lit("corporate-body/"), of_agent("URI/IDENTIFIER"))).alias("court_identifier"),
        of_agent("PREFLABEL").alias("court_name"), F.transform("cited", lambda c: F.struct(c["target"].alias("target"), c["scheme"].alias("scheme"), c["citation_type"].alias("type"), F.lit(None).cast("string").alias("title"))).alias("citations"),
        *[first_of(place).alias(f"metadata_{name}") for name, place in NOTICE_METADATA.items()], "decoding", "notice_url",
    )
    rows = said.join(versions, "source_id", "left")
    rows = rows.withColumn("versions", F.coalesce("versions", F.array().cast("array<struct<language: string, format: string, full_text: string, code: string, selected_as: string, source_url: string>>")))
    typed = F.transform("versions", lambda d: F.struct(F.col("kind").alias("doc_type"), d["language"].alias("language"), d["format"].alias("format"), d["full_text"].alias("full_text")))
    notice = F.struct(F.lit("other").alias("doc_type"), F.lit(None).cast("string").alias("language"), F.lit("xml").alias("format"), F.lit(None).cast("string").alias("full_text"))
    first = F.get(F.filter("versions", lambda d: F.coalesce(d["full_text"], F.lit("")) != ""), F.lit(0))["language"]
    of_subject = lambda name: F.col(f"labels_{SUBJECTS.index(name)}")
    metadata = F.struct(*[F.col(f"metadata_{name}").alias(name) for name in NOTICE_METADATA],
        of_subject("RESOURCE_LEGAL_IS_ABOUT_SUBJECT-MATTER").alias("subject_matter"), of_subject("CASE-LAW_IS-ABOUT_CASE-LAW-SUBJECT-MATTER").alias("case_law_subject_matter"),
        F.col("directory_codes").alias("case_law_directory_codes"), of_subject("CASE-LAW_IS_ABOUT_CONCEPT").alias("case_law_directory_labels"), of_subject("IS_ABOUT").alias("eurovoc_descriptors"),
        F.col("have").alias("available_languages"), F.col("own").alias("procedure_language"),
        F.transform("versions", lambda d: F.struct(d["code"].alias("language"), d["selected_as"].alias("selected_as"), d["source_url"].alias("source_url"))).alias("retrieved_languages"),
        F.col("decoding").alias("notice_decoding"), "notice_url",
    )
    return rows.select(
        F.lit("EU").alias("jurisdiction_code"), "source_id", markup.clean_title(F.col("title")).alias("title"), F.lit(None).cast("string").alias("abstract"), _joined(F.array_distinct(F.concat(*map(of_subject, SUBJECTS))), "; ").alias("subject"),
        "decision_date", F.lit(None).cast("date").alias("filing_date"), "publication_date", "case_numbers", F.coalesce(first, markup.language(F.col("own"))).alias("language"),
        F.lit(None).cast("string").alias("law_domain"), F.lit(None).cast("string").alias("law_subfield"), "procedure_type", F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("source_url"), "court_identifier",
        F.concat(typed, F.array(notice)).alias("documents"), markup.parties(F.col("title")).alias("parties"), "citations", F.to_json(metadata).alias("source_metadata"),
        F.when(F.col("court_name").isNotNull(), F.struct(F.col("court_name").alias("name"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("domain"))).alias("court"),
    )


# ---- of records -----------------------------------------------------------------------------------------------------

#: Scalars that a revision is known by, in order; source_metadata is none of them.
FINGERPRINTED = ("jurisdiction_code", "source_id", "source_system", "title", "abstract", "subject", "decision_date", "filing_date", "publication_date", "case_numbers", "language", "law_domain", "law_subfield", "procedure_type", "outcome", "source_url", "court_identifier")
#: Of each child, in order.
FINGERPRINTED_CHILDREN = {"documents": ("doc_type", "language", "format", "full_text"), "parties": ("name", "role"), "citations": ("target", "type")}


def record_fingerprint(system: Column) -> Column:
    """Digest of all that a revision of a record would change. Every part is followed by a separator, so counts of children tell too."""
    parts = [system if c == "source_system" else F.array_join(c, "|") if c == "case_numbers" else F.col(c) for c in FINGERPRINTED]
    flat = lambda child, names: F.flatten(F.transform(child, lambda x: F.array(*[x[n] for n in names])))
    return fingerprint(*parts, more=F.concat(*[flat(*c) for c in FINGERPRINTED_CHILDREN.items()]))


def children(records: DataFrame, name: str) -> DataFrame:
    """The rows of a child table: the record's key, the child's place and its fields."""
    return records.select("jurisdiction_code", "source_id", F.posexplode(name).alias("position", "c")).select("jurisdiction_code", "source_id", "position", "c.*")
