"""Table ids as text: plain ids, lineage URIs, and how to read them back."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablecensus.schemas import ID_COLS

# How a lineage link spells a table.
URI_PREFIX = "bigquery:"
SHARDED_PREFIX = "sharded:"


def fqn(project="project_id", dataset="dataset_id", table="table_id") -> Column:
    """``p.d.t``; null as soon as one part is null."""
    return F.concat(
        F.col(project), F.lit("."), F.col(dataset), F.lit("."), F.col(table)
    )


def table_uri(project="project_id", dataset="dataset_id", table="table_id") -> Column:
    """The text under which lineage links know a table."""
    return F.concat(F.lit(URI_PREFIX), fqn(project, dataset, table))


def _id_struct(parts: Column) -> Column:
    return F.when(
        F.size(parts) == 3,
        F.struct(*[F.get(parts, i).alias(c) for i, c in enumerate(ID_COLS)]),
    )


def parse_fqn(text: Column) -> Column:
    """Struct of the three id columns, null unless the text has exactly three parts.

    Prefixes are not looked at and parts may be empty.
    """
    return _id_struct(F.split(text, "\\.", -1))


def parse_fqn_strict(text: Column) -> Column:
    """As :func:`parse_fqn`, but a text with another number of parts fails the job."""
    message = F.concat(
        F.lit("Invalid table id '"), F.coalesce(text, F.lit("NULL")), F.lit("'")
    )
    return F.coalesce(parse_fqn(text), F.raise_error(message))


def split_fqn(text: Column) -> list[Column]:
    """The id columns of an id text.

    Names of datasets and tables hold no dots, those of projects may, so the
    text is taken apart from its end.
    """
    last_two = F.substring_index(text, ".", -2)
    project = F.substr(text, F.lit(1), F.length(text) - F.length(last_two) - 1)
    dataset = F.substring_index(last_two, ".", 1)
    table = F.substring_index(last_two, ".", -1)
    return [c.alias(name) for c, name in zip((project, dataset, table), ID_COLS)]


def project_of(text: Column) -> Column:
    return split_fqn(text)[0]


def uri_path(uri: Column, drop_sharded: bool = True) -> Column:
    """What follows the prefix of a URI known to have it.

    The sharded prefix is dropped once, or not at all.
    """
    plain = F.lit(len(URI_PREFIX) + 1)
    if not drop_sharded:
        return F.substr(uri, plain)
    sharded = URI_PREFIX + SHARDED_PREFIX
    start = F.when(uri.startswith(sharded), F.lit(len(sharded) + 1)).otherwise(plain)
    return F.substr(uri, start)


def _has_dots(text: Column, dots: int) -> Column:
    """Whether there are exactly that many dots."""
    cut = F.substring_index
    return (cut(text, ".", dots + 1) == text) & (cut(text, ".", dots) != text)


def names_table(path: Column) -> Column:
    """Whether a path names a table when it is met at the far end of a link.

    That takes three parts, which leaves out domain-scoped projects and
    column-level ends. Parts may be empty.
    """
    return _has_dots(path, 2)


def is_own_path(path: Column, project: Column) -> Column:
    """Whether a path is the id of a table of ``project``, which may hold dots.

    Looking a table up compares whole texts, so this end of a link is held to
    the project the link is recorded under instead of being parsed.
    """
    rest = F.substr(path, F.length(project) + 2)
    return path.startswith(F.concat(project, F.lit("."))) & _has_dots(rest, 1)


def linked_fqn(uri: Column) -> Column:
    """The id text of the table a link end names, null if it names none.

    The prefix is case-sensitive.
    """
    path = uri_path(uri)
    return F.when(uri.startswith(URI_PREFIX) & names_table(path), path)


def parse_uri(uri: Column) -> Column:
    """As :func:`linked_fqn`, as a struct of the id columns."""
    return parse_fqn(linked_fqn(uri))


def uri_reject_reason(uri: Column) -> Column:
    """Why :func:`linked_fqn` reads no table from ``uri``; null if it reads one."""
    return (
        F.when(uri.isNull(), F.lit("missing"))
        .when(~uri.startswith(URI_PREFIX), F.lit("other_system"))
        .when(linked_fqn(uri).isNull(), F.lit("not_three_parts"))
    )
