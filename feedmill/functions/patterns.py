"""Patterns of the text rules. ``(?U)`` makes Java's classes Unicode-aware, ``(?d)`` lets a dot stop at a line feed only."""

# The formats of the sources, as alternatives in their order.
IMG_BBCODE = r"(?iUd)\[img\](.*?)\[/img\]"
IMG_HTML = r"""(?iU)<img\s+[^>]*src=["']([^"']+)["'][^>]*/?\s*>"""
IMG_HYBRID = r"(?iU)\[img\s+[^\]]*\]"
IMG_HYBRID_URL = r"""(?iU)\[img\s+src=["']?([^"'>\]\s]+)["']?[^\]]*\]"""
CLAN_IMAGE = r"(?iU)\{STEAM_CLAN_IMAGE\}/\S+"
LIST_ITEM_BBCODE, LIST_ITEM_HTML, LIST_ITEM_END = r"(?U)\[\*\]\s*", r"(?iU)<li[^>]*>\s*", r"(?iu)</li>"
BBCODE_TAG = (
    r"(?iU)\[/?(?:b|i|u|s|p|h[1-6]|list|olist|\*|url|quote|code|spoiler|strike|noparse|table|tr|td|th|hr|previewyoutube|img)"
    r"(?:\s[^\]]*|=[^\]]*)?\]"
)
HTML_TAG = r"<[^>]+>"
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"')]
UPPER_HEADER = r"(?U)\\?\[\s*([A-Z][A-Z '/&\-]{1,57}?)\s*\\?\]"
BRACKET_HEADER = r"(?U)^\\?\[\s*([A-Za-z][A-Za-z '/&\-]{1,57}?)\s*\\?\]$"
SECTION_HEADER = r"^[A-Z][A-Za-z '/&\-]{2,58}$"
BULLET = r"(?U)^(?:\s*[-•*]|\s*\d+[.)]\s)"
BULLET_MARK, NUMBER_MARK = r"(?U)^[-•*]\s*", r"(?U)^\d+[.)]\s*"
BM25_TOKEN = r"[a-z0-9]+(?:[._-][a-z0-9]+)*"

TITLE_NEWSLETTER = r"newsletter|neowsletter|digest|community\s+hub|director'?s?\s+letter"
TITLE_EVENT = r"watch\b|livestream|live\s+on\b|free\s+weekend|twitch"
TITLE_PATCH = r"patch\b|hotfix|changelog|update\s+summary|patch\s+notes?|release\s+notes?|bug\s*fix|fixed\s+\w+|update\s+\d+\.\d+|\w+\s+update\s*$"
CONTENT_PATCH = (
    r"bug\s*fix|balance\s*change|patch\s+notes?|fixed\s+(?:a|an|the|crash|issue|bug|error|problem)|fix\s+for\b|"
    r"fixes\s+(?:a|an|the|for|to|crash|issue|bug)|crash\s+fix|resolved\s+(?:a|an|the|issue|bug|crash)|addressed\s+(?:a|an|the|issue|bug)|corrected\s+(?:a|an|the)"
)
CONTENT_EVENT = (
    r"double\s+xp|sale|discount|\d+%\s+off|free\s+weekend|tournament|community\s+event|giveaway|limited\s+time|weekend\s+event|"
    r"celebration|anniversary\s+event|contest|sweepstakes|live\s+stream|league|competition|compete|sign\s*ups?\b|1v1|2v2|"
    r"esports?|championship|showmatch|invitational"
)
