"""Fixed values of the analysis: lists, limits, messages and versions."""

from __future__ import annotations

SCHEMA_VERSION = ANALYZER_VERSION = "1.0.0"
SPEC_VERSION = "agentskills-2025-12"

SKILL_FILE = "SKILL.md"
KINDS = ("instructions", "reference", "asset", "script", "readme", "license", "other")
DEFAULT_TOKENIZER = "approx-chars-4"
BODY_TOKEN_LIMIT, BODY_LINE_LIMIT = 4000, 500
NAME_LIMIT, DESCRIPTION_LIMIT, COMPATIBILITY_LIMIT = 64, 1024, 500
LICENSE_HEAD_LINES = 20

# Path segments that are ignored by default.
DEFAULT_IGNORE = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".DS_Store", "Thumbs.db", ".github", ".gitlab", ".gitignore", ".gitattributes", ".gitmodules",
    ".vscode", ".idea", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".venv", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb",
)

# Root files, in lower case, that are never orphans.
CONVENTION_FILES = ("agents.md",)
SCAFFOLDING_FILES = (
    "contributing", "contributing.md", "changelog", "changelog.md", "code_of_conduct.md", "security.md", "support.md", "sponsors.md", "governance.md",
    "authors", "authors.md", "notice", "notice.md", "maintainers.md",
)
README_NAMES = ("readme.md", "readme")
LICENSE_NAMES = ("license", "license.txt", "license.md", "copying")
RESERVED_NAMES = ("default", "example", "demo", "test", "sample", "template")

# License ids, and what a license file's head must hold for each.
SPDX_IDS = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "MPL-2.0", "ISC", "Unlicense")
SPDX_HEADS = (
    ("MIT", ("MIT License",)),
    ("Apache-2.0", ("Apache License", "Version 2.0")),
    ("GPL-3.0-only", ("GNU GENERAL PUBLIC LICENSE", "Version 3")),
    ("GPL-2.0-only", ("GNU GENERAL PUBLIC LICENSE", "Version 2")),
    ("MPL-2.0", ("Mozilla Public License", "2.0")),
    ("BSD-3-Clause", ("BSD 3-Clause",)),
    ("BSD-2-Clause", ("BSD 2-Clause",)),
    ("ISC", ("ISC License",)),
    ("Unlicense", ("This is free and unencumbered software released into the public domain",)),
)

_SPLIT = "Move detail into references/ files that agents load on demand (progressive disclosure)."
# Code, default severity, message, hint.
REGISTRY = (
    ("no-skill-md", "error", "No SKILL.md found at the skill root.", "Every skill needs a SKILL.md file at the root of its folder."),
    ("frontmatter-parse", "error", "SKILL.md frontmatter is not valid YAML.", "Fix the YAML between the opening and closing --- fences."),
    ("name-missing", "error", 'Frontmatter is missing the required "name" field.', None),
    ("name-too-long", "error", 'Frontmatter "name" exceeds the 64-character limit.', None),
    ("name-invalid", "error", 'Frontmatter "name" must be lowercase letters, digits, and hyphens — no leading, trailing, or consecutive hyphens.', None),
    ("name-reserved", "off", 'Frontmatter "name" is a reserved word.', "Choose a different skill name."),
    ("name-dir-mismatch", "warning", 'Frontmatter "name" does not match the skill folder name.', "Rename the folder or the skill so they match."),
    ("description-missing", "error", 'Frontmatter is missing the required "description" field.', None),
    ("description-too-long", "error", 'Frontmatter "description" exceeds the 1024-character limit.', None),
    ("compatibility-too-long", "warning", 'Frontmatter "compatibility" exceeds the 500-character limit.', None),
    ("metadata-non-string", "warning", 'Frontmatter "metadata" values must be strings.', "Quote the value in YAML; the analyzer stringified it best-effort."),
    ("version-missing", "warning", 'Frontmatter "metadata.version" is not set.', "Add metadata.version so consumers can track releases."),
    ("allowed-tools-experimental", "warning", "allowed-tools is experimental and support varies across agents.", None),
    ("body-too-long", "warning", "SKILL.md body exceeds the recommended token budget.", _SPLIT),
    ("body-too-many-lines", "warning", "SKILL.md body exceeds the recommended line count.", _SPLIT),
    ("readme-missing", "warning", "No README found in the skill folder.", "Add a README.md to make the skill page readable."),
    ("license-missing", "warning", "No license declaration or LICENSE file found.", "Add a LICENSE file or set frontmatter.license."),
    ("license-file-missing", "warning", "Frontmatter declares a license but no LICENSE file was found.", "Add a LICENSE file to match the frontmatter.license declaration."),
    ("broken-ref", "warning", "Referenced path does not exist in the skill.", "Fix the path or remove the reference from SKILL.md."),
    ("external-ref", "warning", "Referenced path is outside the skill folder and cannot be resolved here.", "This is expected for cross-skill references; ensure the sibling exists in the package."),
    ("orphan-file", "warning", "File is not reachable from SKILL.md through any chain of references.", "Reference it from SKILL.md (directly, or via a reachable doc or script) or remove it to keep the skill lean."),
    ("file-too-large", "warning", "File exceeds the maxFileBytes limit and was excluded from the manifest.", "Raise options.maxFileBytes or shrink the file."),
)
