"""Rule tables: the words, names, limits and formats results depend on.

Everything in this module is a *fixed value*: it has to be exactly this, in
exactly this order, for results to be right.  Order is meaningful wherever a
"first match wins" rule reads the table.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
# File inventory

IGNORED_DIRS = (
    "node_modules",
    ".git",
    "dist",
    "build",
    ".next",
    "coverage",
    "__pycache__",
    ".venv",
    "venv",
)
IGNORED_LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml")

CONFIG_NAMES = (
    "package.json",
    "tsconfig.json",
    "pyproject.toml",
    "setup.py",
    "go.mod",
    "Cargo.toml",
    "Dockerfile",
)
# Starred config patterns as regular expressions; `.` stays a wildcard and the
# match is unanchored.  The workflow pattern holds a slash, so no base name can
# ever match it; it is listed for completeness.
CONFIG_REGEXES = (
    r".eslintrc.*",
    r".prettierrc.*",
    r"docker-compose.*.yml",
    r".github/workflows/.*.yml",
)

TEST_MARKERS = (".test.", ".spec.", "_test.", "test_")
TEST_DIRS = ("tests/", "test/", "__tests__/")

LOCAL_TEXT_LIMIT = 10_000
REMOTE_TEXT_LIMIT = 5_000

# ---------------------------------------------------------------- fixed values
# Language and framework

LANGUAGE_BY_EXTENSION = (
    (".ts", "TypeScript"),
    (".tsx", "TypeScript"),
    (".js", "JavaScript"),
    (".jsx", "JavaScript"),
    (".py", "Python"),
    (".go", "Go"),
    (".rs", "Rust"),
    (".java", "Java"),
    (".cs", "C#"),
    (".rb", "Ruby"),
    (".php", "PHP"),
)
REMOTE_UNSUPPORTED_EXTENSIONS = (".php",)

NODE_FRAMEWORKS = (
    ("next", "Next.js"),
    ("react", "React"),
    ("vue", "Vue"),
    ("@angular/core", "Angular"),
    ("express", "Express.js"),
    ("fastify", "Fastify"),
    ("nestjs", "NestJS"),
)
PYTHON_FRAMEWORKS = (("django", "Django"), ("flask", "Flask"), ("fastapi", "FastAPI"))
GO_FRAMEWORKS = (("gin-gonic", "Gin"), ("echo", "Echo"), ("fiber", "Fiber"))

FRAMEWORK_FILES = (
    ("next.config.js", "Next.js"),
    ("next.config.mjs", "Next.js"),
    ("angular.json", "Angular"),
    ("vue.config.js", "Vue"),
    ("nuxt.config.ts", "Nuxt"),
    ("nuxt.config.js", "Nuxt"),
)

# ---------------------------------------------------------------- fixed values
# Directories, domains, samples

SOURCE_DIRS = ("src", "lib", "app", "pkg", "internal", "cmd")
REMOTE_SOURCE_DIRS = ("src", "lib", "app", "pkg", "cmd")
FALLBACK_SOURCE_DIRS = 3

DOMAIN_NAMES = (
    "api", "auth", "backend", "frontend", "core", "common", "shared",
    "services", "handlers", "controllers", "models", "views", "routes",
    "components", "hooks", "utils", "lib", "pkg", "internal", "cmd",
    "client", "server", "admin", "public", "private", "modules",
)
DOMAIN_MIN_FILES = 5  # strictly more than this many

SAMPLE_FILES = 20
SAMPLE_MAX_SIZE = 10_000
PRIORITY_FILES = 15
PRIORITY_MAX_SIZE = 50_000
PRIORITY_NAMES = (
    "package.json",
    "tsconfig.json",
    "pyproject.toml",
    "setup.py",
    "go.mod",
    "Cargo.toml",
    "README.md",
)
PRIORITY_SOURCE_EXTENSIONS = (".ts", ".js", ".py", ".go", ".rs", ".java")
PROMPT_PATHS = 100

# ---------------------------------------------------------------- fixed values
# Licences: SPDX id -> lower-case phrases, first hit in this order wins

LICENSE_PHRASES = (
    ("MIT", ("mit license", "the mit license", "mit-license")),
    ("Apache-2.0", ("apache license", "apache-2.0", "apache 2.0", "licensed under the apache license")),
    ("BSD-2-Clause", ("bsd 2-clause", "bsd-2-clause", "simplified bsd", "freebsd license")),
    ("BSD-3-Clause", ("bsd 3-clause", "bsd-3-clause", "new bsd", "modified bsd")),
    ("0BSD", ("zero-clause bsd", "0bsd")),
    ("GPL-2.0", ("gnu general public license v2", "gpl-2.0", "gplv2", "gnu gpl v2")),
    ("GPL-3.0", ("gnu general public license v3", "gpl-3.0", "gplv3", "gnu gpl v3")),
    ("LGPL-2.1", ("gnu lesser general public license v2.1", "lgpl-2.1", "lgplv2.1")),
    ("LGPL-3.0", ("gnu lesser general public license v3", "lgpl-3.0", "lgplv3")),
    ("AGPL-3.0", ("gnu affero general public license", "agpl-3.0", "agplv3")),
    ("ISC", ("isc license",)),
    ("MPL-2.0", ("mozilla public license", "mpl-2.0", "mpl 2.0")),
    ("Unlicense", ("unlicense", "this is free and unencumbered software")),
    ("CC0-1.0", ("cc0", "creative commons zero", "cc0-1.0")),
    ("WTFPL", ("wtfpl", "do what the fuck you want")),
    ("Zlib", ("zlib license",)),
    ("BlueOak-1.0.0", ("blue oak model license",)),
)
PROPRIETARY_PHRASES = (
    "all rights reserved",
    "proprietary",
    "confidential",
    "not for redistribution",
    "may not be copied",
)
PROPRIETARY_VETO = "mit"

LICENSE_FILES = (
    "LICENSE",
    "LICENSE.md",
    "LICENSE.txt",
    "LICENCE",
    "LICENCE.md",
    "LICENCE.txt",
    "license",
    "license.md",
    "license.txt",
    "COPYING",
    "COPYING.md",
    "COPYING.txt",
)
# `license = "..."` or `license = {...}` in pyproject.toml
PYPROJECT_LICENSE = r"""(?i)license\s*=\s*["{]([^"}]+)["}]"""

# Not a result value: cheap substrings such that every phrase above holds at
# least one of them, so a text without any anchor cannot match any phrase.
LICENSE_ANCHORS = ("licen", "apache", "bsd", "gpl", "gnu gpl", "mpl", "cc0",
                   "commons zero", "wtfpl", "what the fuck", "unencumbered")

# ---------------------------------------------------------------- fixed values
# Default tools and hooks by language

NODE_LANGUAGES = ("TypeScript", "JavaScript")

CONFIG_TOOLS = {
    "node": (
        ("install", "npm install", "Install dependencies"),
        ("build", "npm run build", "Build the project"),
        ("test", "npm test", "Run tests"),
        ("lint", "npm run lint", "Run linter"),
    ),
    "Python": (
        ("install", "pip install -e .", "Install dependencies"),
        ("test", "pytest", "Run tests"),
        ("lint", "ruff check .", "Run linter"),
    ),
    "Go": (
        ("build", "go build ./...", "Build the project"),
        ("test", "go test ./...", "Run tests"),
        ("lint", "golangci-lint run", "Run linter"),
    ),
}
PLAIN_TOOLS = {
    "node": (
        ("install", "npm install", "Install dependencies"),
        ("build", "npm run build", "Build"),
        ("test", "npm test", "Run tests"),
    ),
    "Python": (
        ("install", "pip install -e .", "Install"),
        ("test", "pytest", "Run tests"),
    ),
    "Go": (
        ("build", "go build ./...", "Build"),
        ("test", "go test ./...", "Run tests"),
    ),
}
# language group -> (pre-commit description, pre-commit commands, pre-push command)
HOOK_COMMANDS = {
    "node": ("Run linting and type checking before commit", ("npm run lint", "npm run build"), "npm test"),
    "Python": ("Run linting and formatting before commit", ("ruff check .", "ruff format --check ."), "pytest"),
    "Go": ("Run linting and formatting before commit", ("go fmt ./...", "golangci-lint run"), "go test ./..."),
}
HOOK_EVENTS = ("pre-commit", "post-commit", "pre-push", "pre-analyze", "post-generate")

# ---------------------------------------------------------------- fixed values
# Model responses

SKILL_CATEGORIES = ("architecture", "reliability", "quality", "security", "patterns")
SKILL_NAME_MAX = 64
CATEGORY_DESCRIPTIONS = (
    ("architecture", "Structural patterns and system design"),
    ("reliability", "Error handling, recovery, and fault tolerance"),
    ("quality", "Testing, validation, and code quality"),
    ("security", "Authentication, authorization, and data protection"),
    ("patterns", "Common code patterns and conventions"),
)
CATEGORY_FALLBACK = "General patterns"

# ---------------------------------------------------------------- fixed values
# Catalogue scores

SCORE_NAME_EQUALS = 100
SCORE_NAME_CONTAINS = 50
SCORE_DESCRIPTION = 30
SCORE_TRIGGER_CONTAINS = 20
SCORE_TRIGGER_EQUALS = 40
SCORE_CATEGORY = 10
SCORE_ROOT_AGENT = 5

# ---------------------------------------------------------------- fixed values
# Documents

EDITOR_TOOLS = (
    "codebase",
    "textSearch",
    "fileSearch",
    "readFile",
    "listDirectory",
    "usages",
    "problems",
    "fetch",
    "githubRepo",
    "editFiles",
    "createFile",
    "createDirectory",
    "runInTerminal",
    "terminalLastCommand",
    "changes",
)
DELEGATE_TOOL = "runSubagent"
CONVENTIONS_MAX = 15
TESTING_MAX = 8
TEST_COMMAND_WORDS = ("test", "jest", "vitest", "pytest")
PATTERN_LANGUAGES = (
    ("TypeScript", ("typescript", ".ts")),
    ("Python", ("python", ".py")),
    ("JavaScript", ("javascript", ".js")),
    ("Go", ("golang", ".go")),
    ("Rust", ("rust", ".rs")),
)
NOT_DETECTED = "unknown"
DEFAULT_PATTERNS = "- Patterns extracted from codebase analysis"
DEFAULT_EXAMPLES = "See source files in the repository for examples."

# ---------------------------------------------------------------- fixed values
# Sessions

SESSION_SECONDS = 120
EVENT_DELTA = "assistant.message_delta"
EVENT_MESSAGE = "assistant.message"
EVENT_IDLE = "session.idle"
EVENT_ERROR = "error"

# ---------------------------------------------------------------- our own wording
# Sentences for empty parts of documents

DEFAULT_SKILLS = "None listed."
DEFAULT_COMMANDS = "- Use the build command of the project"
DEFAULT_SUB_COMMANDS = "- Use the commands of the coordinating document"
