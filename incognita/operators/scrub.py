"""Header scrubbing as higher-order array expressions (narrow: no shuffle, no UDF).

Every rule is local to one file, so the whole scrub is one projection over the
``elements`` array and stays inside whole-stage code generation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from incognita import model
from incognita.functions.tags import col, element, is_curve, is_private


def drop_private(elements: Column | str) -> Column:
    """Remove private elements and everything nested under a private sequence."""
    return F.filter(col(elements), lambda e: ~F.exists(e["path_tags"], is_private))


def drop_group_mask(elements: Column | str, mask: int = model.CURVE_GROUP_MASK,
                    value: int = model.CURVE_GROUP_VALUE) -> Column:
    """Remove elements whose group matches ``(group & mask) == value`` at any depth."""
    return F.filter(col(elements), lambda e: ~F.exists(
        e["path_tags"], lambda t: F.shiftright(t, 16).bitwiseAND(mask) == value))


def drop_curves(elements: Column | str) -> Column:
    return F.filter(col(elements), lambda e: ~F.exists(e["path_tags"], is_curve))


def drop_tags(elements: Column | str, tags: list[int]) -> Column:
    """Remove elements with one of ``tags`` and all their descendants."""
    if not tags:
        return col(elements)
    lits = [F.lit(t).cast("bigint") for t in tags]
    return F.filter(col(elements), lambda e: ~F.exists(e["path_tags"], lambda t: t.isin(*lits)))


def replace_by_vr(elements: Column | str, replacements: dict[str, str] | None = None) -> Column:
    """Set the value of every element of a listed VR, at every depth."""
    replacements = model.VR_REPLACEMENTS if replacements is None else replacements
    if not replacements:
        return col(elements)

    return F.transform(col(elements), lambda e: element(e["pos"], e["path_tags"], e["keyword"], e["vr"], vr_value(e, replacements)))


def vr_value(e: Column, replacements: dict[str, str]) -> Column:
    """An element's value, or that of its VR if the VR is listed."""
    v = None
    for vr, new in replacements.items():
        v = (F.when(e["vr"] == vr, F.lit(new)) if v is None else v.when(e["vr"] == vr, F.lit(new)))
    return e["value"] if v is None else v.otherwise(e["value"])


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fixed_elements(fixed: list[model.Fixed], study_id: Column, patient_name: Column) -> Column:
    """The upserted elements as one array: constant ones parsed once as a SQL literal."""
    const = [f for f in fixed if f.value not in (model.STUDY_ID_VALUE, model.PATIENT_NAME_VALUE)]
    dyn = [f for f in fixed if f.value in (model.STUDY_ID_VALUE, model.PATIENT_NAME_VALUE)]
    parts = []
    if const:
        items = ", ".join(
            f"named_struct('pos', array(CAST({f.tag} AS BIGINT)), 'path_tags', array(CAST({f.tag} AS BIGINT)), "
            f"'keyword', {_sql_str(f.keyword)}, 'vr', {_sql_str(f.vr)}, 'value', {_sql_str(f.value)})"
            for f in const)
        parts.append(F.expr(f"array({items})"))
    if dyn:
        arrs = []
        for f in dyn:
            arr = F.array(F.lit(f.tag).cast("bigint"))
            arrs.append(element(arr, arr, F.lit(f.keyword), F.lit(f.vr), fixed_value(f, study_id, patient_name)))
        parts.append(F.array(*arrs))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def fixed_value(f: model.Fixed, study_id: Column, patient_name: Column) -> Column:
    if f.value == model.STUDY_ID_VALUE:
        return study_id.cast("string")
    if f.value == model.PATIENT_NAME_VALUE:
        return patient_name.cast("string")
    return F.lit(f.value)


def upsert_top_level(elements: Column | str, fixed: list[model.Fixed],
                     study_id: Column, patient_name: Column) -> Column:
    """Create or replace top-level elements; a replaced element loses its children."""
    if not fixed:
        return col(elements)
    tags = [F.lit(f.tag).cast("bigint") for f in fixed]
    kept = F.filter(col(elements), lambda e: ~e["path_tags"][0].isin(*tags))
    return F.sort_array(F.concat(kept, fixed_elements(fixed, study_id, patient_name)))


@dataclass(frozen=True)
class Rules:
    """A scrub rule table. Defaults reproduce the reference's hard-coded rules.

    Applied in this order: path rules, private removal, value-type replacement, group-mask
    removal (curves), top-level upserts, tag removal (request attributes). A path
    rule names an element by the tags from the top level down, whatever the item numbers:
    its new value (which the value types leave alone), or None to remove it with all below.
    """
    drop_private: bool = True
    vr_values: dict = field(default_factory=lambda: dict(model.VR_REPLACEMENTS))
    group_masks: tuple = ((model.CURVE_GROUP_MASK, model.CURVE_GROUP_VALUE),)
    fixed: tuple = tuple(model.FIXED_ASSIGNMENTS)
    drop_tags: tuple = (model.REQUEST_ATTRIBUTES_SEQUENCE,)
    paths: tuple = ()  # (tag path, value or None); the first rule of a path counts

    @staticmethod
    def from_rows(rows) -> "Rules":
        """Build rules from rows of a small rule table.

        Each row has ``action`` in {drop_private, set_vr, drop_group, upsert,
        drop_tag, set_path, drop_path} and the fields it needs: ``vr``, ``value``, ``tag``,
        ``mask``, ``keyword``, ``path`` (tags joined by "/"). An upsert value of ``<study_id>`` or
        ``<patient_name>`` takes the file's assigned ID or the run's patient
        name. The table is configuration (up to thousands of rows).
        """
        priv, vr_values, masks, fixed, tags, paths = False, {}, [], [], [], []
        for r in rows:
            d = r.asDict() if hasattr(r, "asDict") else dict(r)
            a = d["action"]
            if a == "drop_private":
                priv = True
            elif a == "set_vr":
                vr_values[d["vr"]] = d.get("value") or ""
            elif a == "drop_group":
                masks.append((int(d["mask"]), int(d["tag"])))
            elif a == "upsert":
                fixed.append(model.Fixed(d["keyword"], int(d["tag"]), d["vr"], d.get("value") or ""))
            elif a == "drop_tag":
                tags.append(int(d["tag"]))
            elif a in ("set_path", "drop_path"):
                paths.append((tuple(int(t) for t in d["path"].split("/")), (d.get("value") or "") if a == "set_path" else None))
            else:
                raise ValueError(f"unknown scrub action: {a}")
        return Rules(priv, vr_values, tuple(masks), tuple(fixed), tuple(tags), tuple(paths))


DEFAULT_RULES = Rules()
# The reference's request-sequence guard never fires; this reproduces it.
REFERENCE_LITERAL_RULES = Rules(drop_tags=())


def _path_key(path_tags: Column) -> Column:
    return F.array_join(path_tags.cast("array<string>"), "/")


def _path_tables(paths) -> tuple[list[str], dict[str, str]]:
    """Keys of the paths to remove and values of those to set."""
    first: dict[str, str | None] = {}
    for path, value in paths:
        first.setdefault("/".join(str(t) for t in path), value)
    return [k for k, v in first.items() if v is None], {k: v for k, v in first.items() if v is not None}


def drop_paths(elements: Column | str, paths: list[str]) -> Column:
    """Remove the elements of some paths and all below them.

    A path's beginnings are looked up in one hash set, and only those as deep as a rule.
    """
    if not paths:
        return col(elements)
    depths = sorted({p.count("/") + 1 for p in paths})

    def named(e):
        c = F.lit(False)
        for d in depths:
            c = c | ((F.size(e["path_tags"]) >= d) & _path_key(F.slice(e["path_tags"], 1, d)).isin([p for p in paths if p.count("/") + 1 == d]))
        return c

    return F.filter(col(elements), lambda e: ~named(e))


def set_paths(elements: Column | str, values: dict[str, str], otherwise=lambda e: e["value"]) -> Column:
    """Set the value of the elements of some paths; the others get ``otherwise``.

    A hash set tells the paths without a rule, so the values are searched for the few that have one.
    """
    table = F.expr("map(" + ", ".join(f"{_sql_str(k)}, {_sql_str(v)}" for k, v in values.items()) + ")") if values else None

    def rewrite(e):
        value = otherwise(e)
        if values:
            key = _path_key(e["path_tags"])
            value = F.when(key.isin(list(values)), F.element_at(table, key)).otherwise(value)
        return element(e["pos"], e["path_tags"], e["keyword"], e["vr"], value)

    return F.transform(col(elements), rewrite)


def scrub(elements: Column | str, study_id: Column | None = None, patient_name: Column | None = None,
          rules: Rules = DEFAULT_RULES) -> Column:
    """The full element scrub for one file, fused into one filter and one transform.

    Same result as applying the rules one by one in order (private removal,
    value-type replacement, group-mask removal, top-level upserts, tag
    removal): removals and the value rewrite do not touch tags, and the
    upserted elements are top level and come after the first three rules,
    so only the last rule can affect them; it is applied to the upsert list.
    """
    study_id = F.lit(model.DEFAULT_PATIENT_ID) if study_id is None else study_id
    patient_name = F.lit(model.DEFAULT_PATIENT_NAME) if patient_name is None else patient_name
    drop = [F.lit(t).cast("bigint") for t in rules.drop_tags]
    fixed = [f for f in rules.fixed if f.tag not in set(rules.drop_tags)]
    fixed_tags = [F.lit(f.tag).cast("bigint") for f in rules.fixed]

    def removed_tag(t):
        c = F.lit(False)
        if rules.drop_private:
            c = c | is_private(t)
        for mask, value in rules.group_masks:
            c = c | (F.shiftright(t, 16).bitwiseAND(mask) == value)
        if drop:
            c = c | t.isin(*drop)
        return c

    def keep(e):
        c = ~F.exists(e["path_tags"], removed_tag)
        if fixed_tags:
            c = c & ~e["path_tags"][0].isin(*fixed_tags)
        return c

    gone, values = _path_tables(rules.paths)
    kept = F.filter(drop_paths(elements, gone), keep)
    out = set_paths(kept, values, lambda e: vr_value(e, rules.vr_values)) if values else replace_by_vr(kept, rules.vr_values)
    if not fixed:
        return out
    return F.sort_array(F.concat(out, fixed_elements(fixed, study_id, patient_name)))


def scrub_stepwise(elements: Column | str, study_id: Column | None = None, patient_name: Column | None = None,
                   rules: Rules = DEFAULT_RULES) -> Column:
    """The same scrub as ``scrub``, one rule at a time (the specification)."""
    study_id = F.lit(model.DEFAULT_PATIENT_ID) if study_id is None else study_id
    patient_name = F.lit(model.DEFAULT_PATIENT_NAME) if patient_name is None else patient_name
    gone, values = _path_tables(rules.paths)
    out = drop_paths(elements, gone)
    if rules.drop_private:
        out = drop_private(out)
    out = set_paths(replace_by_vr(out, rules.vr_values), values)
    for mask, value in rules.group_masks:
        out = drop_group_mask(out, mask, value)
    out = upsert_top_level(out, list(rules.fixed), study_id, patient_name)
    out = drop_tags(out, list(rules.drop_tags))
    return out


def anon_name(irb_code: Column, root: Column) -> Column:
    """Patient name written into every file: the IRB code, else the root's last component."""
    fallback = F.regexp_extract(root, r"([^/\\]+)[/\\]*$", 1)
    return F.coalesce(F.nullif(F.trim(irb_code), F.lit("")), fallback)


def output_path(root: Column | str = "root", path: Column | str = "path", suffix: str = "-anon") -> Column:
    """Mirror a file into ``<root>-anon`` keeping the path below the root."""
    r, p = col(root), col(path)
    return F.concat(r, F.lit(suffix), F.substr(p, F.length(r) + 1))
