"""Reading loosely typed JSON: the JavaScript rules for truth, numbers and text.

Every function takes and returns SQL text, so that the rules nest inside lambdas and a whole rule
is parsed in one go. Arguments are VARIANT expressions.
"""

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
EXACT_TYPES = "'VOID', 'STRING', 'BOOLEAN'"


def json_list(text: str) -> str:
    """The JSON object inside a model reply, as a VARIANT list.

    The parser stops after one value; inside a list, anything that follows makes it fail.
    """
    bare = rf"regexp_replace({text}, r'```json\s*|```', '')"
    return rf"try_parse_json(concat('[', regexp_extract({bare}, r'(?s)\{{.*\}}', 0), ']'))"


def only_element(listed: str) -> str:
    """The object, or NULL when there is none, or more than one value."""
    second = f"try_variant_get({listed}, '$[1]', 'variant')"
    return f"CASE WHEN {second} IS NULL THEN try_variant_get({listed}, '$[0]', 'variant') END"


def member(value: str, name: str, kind: str = "variant") -> str:
    """A member; NULL when it is missing (as VARIANT, a JSON null is not NULL)."""
    return f"try_variant_get({value}, '$.{name}', '{kind}')"


def elements(value: str) -> str:
    return f"try_variant_get({value}, '$', 'array<variant>')"


def kind(value: str) -> str:
    """NUMBER, STRING, BOOLEAN, VOID (a JSON null), ARRAY or OBJECT; NULL when missing."""
    schema = f"schema_of_variant({value})"
    return (
        f"CASE WHEN {value} IS NULL THEN NULL WHEN {schema} IN ({EXACT_TYPES}) THEN {schema}"
        f" WHEN startswith({schema}, 'OBJECT') THEN 'OBJECT' WHEN startswith({schema}, 'ARRAY') THEN 'ARRAY'"
        " ELSE 'NUMBER' END"
    )


def as_text(value: str) -> str:
    return f"try_variant_get({value}, '$', 'string')"


def as_double(value: str) -> str:
    return f"try_variant_get({value}, '$', 'double')"


def to_number(value: str) -> str:
    """JavaScript ``Number(value)``; NULL stands for NaN and for a missing value."""
    text = as_text(value)
    return (
        f"CASE {kind(value)} WHEN 'VOID' THEN 0D WHEN 'NUMBER' THEN {as_double(value)}"
        f" WHEN 'BOOLEAN' THEN if({text} = 'true', 1D, 0D)"
        f" WHEN 'STRING' THEN CASE WHEN trim({text}) = '' THEN 0D"
        f" WHEN {text} RLIKE r'{NUMBER}' THEN try_cast(trim({text}) AS DOUBLE) END END"
    )


def truthy(value: str) -> str:
    text = as_text(value)
    return (
        f"coalesce(CASE {kind(value)} WHEN 'OBJECT' THEN true WHEN 'ARRAY' THEN true"
        f" WHEN 'NUMBER' THEN {as_double(value)} != 0 WHEN 'STRING' THEN {text} != ''"
        f" WHEN 'BOOLEAN' THEN {text} = 'true' END, false)"
    )


def truthy_primitive(value: str) -> str:
    return f"({truthy(value)} AND {kind(value)} IN ('STRING', 'NUMBER', 'BOOLEAN'))"


def truthy_text(value: str) -> str:
    """Text of a scalar, NULL when it is falsy or not a scalar."""
    return f"CASE WHEN {truthy_primitive(value)} THEN {as_text(value)} END"


def members(value: str) -> str:
    """The members of a JSON object as a map; NULL for anything else."""
    return f"try_variant_get({value}, '$', 'map<string,variant>')"


def overlaid(value: str, name: str, new: str) -> str:
    """The JSON object ``value`` with every member it has, and ``name`` set to the VARIANT ``new``."""
    kept = f"map_filter(coalesce({members(value)}, map_from_arrays(array(), array())), (k, v) -> k != '{name}')"
    return f"to_variant_object(map_concat(CAST({kept} AS map<string,variant>), map('{name}', {new})))"


def spread(value: str) -> str:
    """What JavaScript's ``{...value}`` gives: members of an object, else elements or characters by their number."""
    listed = f"transform({elements(value)}, (x, i) -> named_struct('key', CAST(i AS STRING), 'value', x))"
    chars = f"transform(filter(split({as_text(value)}, ''), c -> c != ''), (c, i) -> named_struct('key', CAST(i AS STRING), 'value', CAST(c AS VARIANT)))"
    return (
        f"CASE {kind(value)} WHEN 'OBJECT' THEN {value} WHEN 'ARRAY' THEN to_variant_object(map_from_entries({listed}))"
        f" WHEN 'STRING' THEN to_variant_object(map_from_entries({chars})) END"
    )
