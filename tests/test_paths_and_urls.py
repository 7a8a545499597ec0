"""Path, text and URL scalars, with the traps their exact rules contain."""

from pyspark.sql import functions as F

from repoquarry import rules
from repoquarry.functions import paths, text, urls


def test_is_test(column_of):
    true = ["src/utils.test.ts", "src/utils.spec.ts", "tests/integration.ts", "__tests__/component.tsx", "test_utils.py",
            "handler_test.go", "src/latest_news.ts", "TESTS\\a.py", "test/x.js", "SRC/A.TEST.TS"]
    false = ["src/index.ts", "src/tests/a.ts", "contest.py", "src/testing.ts"]
    assert column_of(paths.is_test, true) == [True] * len(true)
    assert column_of(paths.is_test, false) == [False] * len(false)


def test_is_config(column_of):
    true = ["package.json", "tsconfig.json", "Dockerfile", "my-package.json.bak", "a/go.mod", ".eslintrc.js", "docker-compose.dev.yml",
            "x/.prettierrc.json", "docker-composeXyml.yml"]
    false = [".github/workflows/ci.yml", "src/index.ts", "eslintrc", "compose.yml"]
    assert column_of(paths.is_config, true) == [True] * len(true)
    assert column_of(paths.is_config, false) == [False] * len(false)


def test_extensions(column_of):
    given = ["a/b.ts", "README", ".env", "x.tar.gz", "a.b/c", "end.", "py"]
    assert column_of(paths.local_extension, given) == [".ts", "", "", ".gz", "", ".", ""]
    assert column_of(paths.remote_extension, given) == [".ts", ".README", ".env", ".gz", ".b/c", ".", ".py"]


def test_ignore_rules(column_of):
    given = ["node_modules/a.js", "packages/a/node_modules/x.js", "src/a.js", "sub/yarn.lock", "xpackage-lock.json", ".env", "a/.env", "mybuild/x", "poetry.lock"]
    local = column_of(lambda c: paths.is_ignored(c, "local"), given)
    remote = column_of(lambda c: paths.is_ignored(c, "remote"), given)
    assert local == [True, True, False, True, False, True, True, False, True]
    assert remote == [True, False, False, True, True, False, False, False, True]


def test_segments(column_of):
    given = ["a/b/c.ts", "a/c.ts", "c.ts"]
    assert column_of(paths.depth, given) == [3, 2, 1]
    assert column_of(paths.first_segment, given) == ["a", "a", None]
    assert column_of(paths.second_segment, given) == ["b", None, None]
    assert column_of(lambda c: paths.first_segment(c, "\\"), ["utils\\x.ts"]) == ["utils"]


def test_utf16_prefix(column_of):
    given = ["ab😀cd", "abcdef", "é" * 5, "", "😀"]
    assert column_of(lambda c: text.utf16_prefix(c, 3), given) == ["ab�", "abc", "ééé", "", "😀"]
    assert column_of(text.utf16_length, given) == [6, 6, 5, 0, 2]


def test_truncation_limits(column_of):
    assert column_of(lambda c: F.char_length(paths.truncate_content(c, "local")), ["x" * 12_000]) == [rules.LOCAL_TEXT_LIMIT]
    assert column_of(lambda c: F.char_length(paths.truncate_content(c, "remote")), ["x" * 12_000]) == [rules.REMOTE_TEXT_LIMIT]


def test_names_and_quotes(column_of):
    assert column_of(text.sanitize_name, ["My Cool Project!", "", "ok", "a😀"]) == ["my-cool-project-", "repo", "ok", "a--"]
    assert column_of(text.title_case, ["auth-login-flow", "patterns", "iOS-app", "a--b"]) == ["Auth Login Flow", "Patterns", "IOS App", "A  B"]
    quoted = column_of(text.yaml_quote, ["Handles auth: login & signup #flows", "Clean description", 'say "a": \\', "'x"])
    assert quoted == ['"Handles auth: login & signup #flows"', "Clean description", '"say \\"a\\": \\\\"', "\"'x\""]
    assert column_of(text.category_description, ["quality", "other"]) == ["Testing, validation, and code quality", "General patterns"]
    assert column_of(text.strip_space, ["\n\t a b 　\r\n"]) == ["a b"]


def test_hosted_urls(column_of):
    true = ["https://github.com/owner/repo", "https://github.com/owner/repo.git", "git@github.com:owner/repo.git", "github.com/owner/repo"]
    false = ["/home/user/project", "https://gitlab.com/owner/repo", "./my-project", "", "my-project"]
    assert column_of(urls.is_github_url, true + false) == [True] * 4 + [False] * 5
    assert column_of(urls.normalize_github_url, true) == ["https://github.com/owner/repo"] * 4
    assert column_of(urls.repo_name, true + ["https://github.com/owner/"]) == ["repo"] * 4 + ["repo"]
    assert column_of(urls.repo_name, ["https://github.com/owner/my-repo.git"]) == ["my-repo"]


def test_owner_and_repo(column_of):
    given = ["https://github.com/owner/repo", "https://github.com/owner/repo.git", "git@github.com:owner/repo.git", "owner/repo",
             "https://github.com/owner/my.repo.name", "https://github.com/my-org/my-repo", "invalid", "https://github.com/"]
    got = [tuple(r) for r in column_of(urls.parse_github_url, given)]
    assert got[:4] == [("owner", "repo", True)] * 4
    assert got[4:6] == [("owner", "my.repo.name", True), ("my-org", "my-repo", True)]
    assert got[6:] == [(None, None, False)] * 2
