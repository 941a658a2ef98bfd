"""Table schemas of a document store and the fixed values of its format."""

from __future__ import annotations

# Column names and meaning are fixed by the store format.
DDL = {
    "node": "node_id long, name string, txt string, syntax string, tags string, is_ro long, "
    "is_richtxt long, has_codebox boolean, has_table boolean, has_image boolean, level long, "
    "ts_creation long, ts_lastsave long",
    "children": "node_id long, father_id long, sequence long, master_id long",
    "codebox": "node_id long, offset long, justification string, txt string, syntax string, "
    "width int, height int, is_width_pix boolean, do_highl_bra boolean, do_show_linenum boolean",
    "grid": "node_id long, offset long, justification string, txt string, col_min int, col_max int, "
    "cells array<array<string>>, is_light boolean, col_widths array<int>",
    "image": "node_id long, offset long, justification string, anchor string, png binary, "
    "filename string, link string, time long",
    "bookmark": "node_id long, sequence long",
}
TABLES = list(DDL)

# Fixed values of the format.
RICH_SYNTAX = "custom-colors"
PLAIN_SYNTAX = "plain-text"
LATEX_FILENAME = "__ct_special.tex"
LIST_BULLETS = "•◇▪-→⇒"
TOC_BULLETS = "▸•◇▪"
TODO_MARKS = "☐☑☒"
LIST_NUMBER_ENDS = ".)->"
LINE_CONTENT_LIMIT = 100
MAX_FILE_NAME_BYTES = 142
PAGE_SIZE = 500
UNDO_LIMIT = 10
BACKUPS_KEPT = 3
RECENT_DOCS = 10
HORIZONTAL_RULE = "~" * 33
TIMESTAMP_FORMAT = "yyyy/MM/dd - HH:mm"
RUN_ATTRIBUTES = [
    "weight", "foreground", "background", "style", "underline", "strikethrough",
    "scale", "invisible", "family", "justification", "link", "indent",
]
