"""Fixed values of the formats read and written.

Names, patterns, labels and messages below are part of the data formats and
must stay exactly as they are for results to agree.
"""

# Hosts and the URL forms built from a file ID, by MIME type.
DRIVE_HOSTS = ("drive.google.com", "docs.google.com")
URL_HEAD = r"https://(?:drive\.google\.com|docs\.google\.com)/"
LINK_FORMS = {
    "application/vnd.google-apps.document": "https://docs.google.com/document/d/%s/edit",
    "application/vnd.google-apps.spreadsheet": "https://docs.google.com/spreadsheets/d/%s/edit",
    "application/vnd.google-apps.presentation": "https://docs.google.com/presentation/d/%s/edit",
    "application/vnd.google-apps.form": "https://docs.google.com/forms/d/e/%s/viewform",
    "application/vnd.google-apps.drawing": "https://docs.google.com/drawings/d/%s/edit",
    "application/vnd.google-apps.folder": "https://drive.google.com/drive/folders/%s",
}
DEFAULT_LINK_FORM = "https://drive.google.com/file/d/%s/view"

# MIME types.
WORKSPACE_PREFIX = "application/vnd.google-apps."
FOLDER = "application/vnd.google-apps.folder"
PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"

# Document kinds that get a stub page: by a piece of the URL, then by MIME type.
URL_KINDS = {
    "docs.google.com/forms": "Google Form",
    "docs.google.com/spreadsheets": "Google Sheet",
    "docs.google.com/presentation": "Google Presentation",
}
DEFAULT_URL_KIND = "Google Document"
MIME_PREFIX_KINDS = {
    "video/": "video file",
    "audio/": "audio file",
    "image/": "image file",
}
MIME_KINDS = {
    "application/vnd.google-apps.presentation": "Google Presentation",
    "application/vnd.google-apps.spreadsheet": "Google Sheet",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "PowerPoint presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "Excel spreadsheet",
}
DEFAULT_MIME_KIND = "media file"

# Access status by HTTP status of the metadata request.
ACCESS_STATUS = {
    200: "available",
    404: "deleted",
    403: "permission_denied",
    400: "invalid",
}
DEFAULT_ACCESS_STATUS = "error"
INVALID_SEED_TITLE = "INVALID_URL"

# Front matter: keys in writing order, and characters that force quoting.
FRONT_MATTER_KEYS = (
    "description",
    "editor",
    "gdrive-link",
    "hash-gdrive",
    "hash-content",
    "published",
    "tags",
    "title",
)
QUOTED_VALUE = r"""[:#@&*!|>'"%\[\]{}]|\A-"""
STUB_HASH = "stub"

# Body texts.
PREAMBLE = "> Link: "
URL_STUB_TEXT = "*This is a %s. This document type cannot be exported to markdown format.*"
MIME_STUB_TEXT = "*This is a %s (%s). Media files cannot be exported to markdown format.*"

# File names.
UNSAFE_NAME_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
EMPTY_NAME = "untitled"
EMPTY_SLUG = "unnamed"
MAX_NAME_BYTES = 255

# Crawl depth when none is given.
DEFAULT_MAX_DEPTH = 5
