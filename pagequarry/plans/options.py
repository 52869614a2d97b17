"""Options of a conversion."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# Each enumeration's names, the default first, and what an unknown name stands for.
ENUMS = {
    "heading_style": (("atx", "underlined", "atxclosed"), "underlined"),
    "list_indent_type": (("spaces", "tabs"), "spaces"),
    "whitespace_mode": (("normalized", "strict"), "normalized"),
    "newline_style": (("spaces", "backslash"), "spaces"),
    "code_block_style": (("backticks", "indented", "tildes"), "indented"),
    "highlight_style": (("doubleequal", "html", "bold", "none"), "none"),
    "link_style": (("inline", "reference"), "inline"),
    "url_escape_style": (("angle", "percent"), "angle"),
    "output_format": (("markdown", "djot", "plain"), "markdown"),
}
_SAME = {"plaintext": "plain", "text": "plain"}


def token(name: str) -> str:
    """Lower case, letters and digits only: ``ATX_CLOSED`` and ``atx-closed`` agree."""
    return "".join(c for c in name.lower() if c.isalnum())


def parse_enum(option: str, name: str) -> str:
    known, unknown = ENUMS[option]
    t = _SAME.get(token(name), token(name))
    return t if t in known else unknown


#: The elements that each callback is asked about.
CALLBACKS = {
    "text": (),
    "custom_element": (),
    "element_start": (),
    "element_end": (),
    "link": ("a",),
    "image": ("img",),
    "heading": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "code_block": ("pre",),
    "code_inline": ("code",),
    "list_item": ("li",),
    "list_start": ("ul", "ol"),
    "list_end": ("ul", "ol"),
    "table_start": ("table",),
    "table_row": ("tr",),
    "table_end": ("table",),
    "strong": ("strong", "b"),
    "emphasis": ("em", "i"),
    "strikethrough": ("del", "s"),
    "underline": ("u",),
    "subscript": ("sub",),
    "superscript": ("sup",),
    "mark": ("mark",),
    "line_break": ("br",),
    "horizontal_rule": ("hr",),
    "blockquote": ("blockquote",),
    "definition_term": ("dt",),
    "definition_description": ("dd",),
    "form": ("form",),
    "input": ("input",),
    "button": ("button",),
    "audio": ("audio",),
    "video": ("video",),
    "iframe": ("iframe",),
    "details": ("details",),
    "summary": ("summary",),
    "figure_start": ("figure",),
    "figure_end": ("figure",),
    "figcaption": ("figcaption",),
}


@dataclass(frozen=True)
class Preprocessing:
    enabled: bool = True
    preset: str = "standard"
    remove_navigation: bool = True
    remove_forms: bool = True

    def __post_init__(self):
        p = token(self.preset)
        object.__setattr__(self, "preset", p if p in ("minimal", "standard", "aggressive") else "standard")


@dataclass(frozen=True)
class Options:
    heading_style: str = "atx"
    list_indent_type: str = "spaces"
    list_indent_width: int = 2
    bullets: str = "-*+"
    strong_em_symbol: str = "*"
    escape_asterisks: bool = False
    escape_underscores: bool = False
    escape_misc: bool = False
    escape_ascii: bool = False
    code_language: str = ""
    autolinks: bool = True
    default_title: bool = False
    br_in_tables: bool = False
    compact_tables: bool = False
    highlight_style: str = "doubleequal"
    extract_metadata: bool = True
    whitespace_mode: str = "normalized"
    strip_newlines: bool = False
    wrap: bool = False
    wrap_width: int = 80
    sub_symbol: str = ""
    sup_symbol: str = ""
    newline_style: str = "spaces"
    code_block_style: str = "backticks"
    keep_inline_images_in: tuple[str, ...] = ()
    preprocessing: Preprocessing = field(default_factory=Preprocessing)
    strip_tags: tuple[str, ...] = ()
    preserve_tags: tuple[str, ...] = ()
    convert_as_inline: bool = False
    skip_images: bool = False
    url_escape_style: str = "angle"
    link_style: str = "inline"
    output_format: str = "markdown"
    include_document_structure: bool = False
    extract_images: bool = False
    max_depth: int | None = None
    exclude_selectors: tuple[str, ...] = ()
    #: Callback name -> {"action": "skip" | "custom" | "custom_template" | "preserve_html" | "continue" | "error", "output": ..., "template": ...,
    #: "message": ...}. ``element_start`` and ``element_end`` are asked about all elements, or those of the "tags" they name.
    visitor: dict = field(default_factory=dict, hash=False)

    def __post_init__(self):
        for name in ENUMS:
            object.__setattr__(self, name, parse_enum(name, getattr(self, name)))
        for name in ("keep_inline_images_in", "strip_tags", "preserve_tags", "exclude_selectors"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if isinstance(self.preprocessing, dict):
            object.__setattr__(self, "preprocessing", Preprocessing(**self.preprocessing))
        object.__setattr__(self, "visitor", {c.removeprefix("visit_"): v for c, v in self.visitor.items()})
        unknown = set(self.visitor) - set(CALLBACKS)
        if unknown:
            raise ValueError(f"no such callbacks: {sorted(unknown)}")
        actions = {v.get("action", "continue") for v in self.visitor.values()} - {"skip", "custom", "custom_template", "preserve_html", "continue", "error"}
        if actions:
            raise ValueError(f"no such visitor actions: {sorted(actions)}")
        if not 1 <= len(self.bullets) <= 10:
            raise ValueError("bullets: 1 to 10 characters")
        if self.strong_em_symbol not in ("*", "_"):
            raise ValueError("strong_em_symbol: * or _")

    @staticmethod
    def of(values: dict) -> "Options":
        """From a dict; names that aren't options are left out."""
        known = {f.name for f in fields(Options)}
        return Options(**{k: v for k, v in values.items() if k in known and v is not None})

    def update(self, **changed) -> "Options":
        """Only what is given changes."""
        return replace(self, **{k: v for k, v in changed.items() if v is not None})
