"""Command lines by example: what each asks for, which form takes it, how it streams, what runs behind its runners. The rows of orders deal them out,
so that routing runs over a table of command lines as large as the data."""

#: (command line, words a blank apart; form or None; what it asks for: "", query, machine or exact; capture, stream or inherit)
LINES = (
    ("git status", "git_status", "", "capture"), ("/usr/bin/git diff HEAD", "git_diff", "", "capture"), ("git log --stat -3", "git_log_stat", "", "capture"), ("git log -3", "git_log", "", "capture"), ("git log --format=%h", None, "exact", "capture"), ("git log -- --format=%h", "git_log", "", "capture"),
    ("git show --pretty", None, "exact", "capture"), ("git --version", None, "query", "capture"), ("git help", None, "query", "capture"), ("git bisect good", None, "", "capture"), ("gt log", "git_stack_log", "", "capture"), ("gt log --json", None, "exact", "capture"), ("gt submit --interactive", None, "", "inherit"),
    ("cargo test", "cargo_test", "", "capture"), ("cargo nextest run", "nextest", "", "capture"), ("cargo nextest run --message-format libtest-json", None, "exact", "capture"), ("cargo build -h", None, "query", "capture"), ("cargo watch", None, "", "inherit"), ("go test ./...", "go_test", "", "capture"), ("go test -json", None, "exact", "capture"),
    ("go test -json=false", "go_test", "", "capture"), ("go run .", None, "", "inherit"), ("jest --ci", "jest", "", "capture"), ("jest --watch", "jest", "", "stream"), ("vitest --reporter=dot", "jest", "", "capture"), ("vitest --reporter json", None, "exact", "capture"), ("pytest -q", "pytest", "", "capture"), ("pytest --co", None, "query", "capture"),
    ("tsc -w", "tsc", "", "stream"), ("tsc --showConfig", None, "query", "capture"), ("rspec -f d", None, "exact", "capture"), ("rspec -fprogress", "rspec", "", "capture"), ("rspec --bisect", "rspec", "", "inherit"), ("rubocop --format json", None, "exact", "capture"), ("rubocop", "rubocop", "", "capture"), ("playwright test --ui", "playwright", "", "inherit"),
    ("find . -name x", "find_paths", "", "capture"), ("find . -delete", None, "exact", "capture"), ("ls -C", "ls_columns", "", "capture"), ("ls -la", None, "exact", "capture"), ("ls -a --classify=auto", "ls", "", "capture"), ("ls --color", None, "exact", "capture"), ("tree -L 2", "tree", "", "capture"), ("tree -J", None, "exact", "capture"), ("du -s x", "du", "", "capture"), ("du x", "du_rows", "", "capture"),
    ("diff a b", "difference", "", "capture"), ("diff -U3 a b", None, "exact", "capture"), ("diff --color=always a b", None, "exact", "capture"), ("head a.py", "file_slice", "", "capture"), ("head -n5 a.py", None, "exact", "capture"), ("tail --lines=3 a", None, "exact", "capture"), ("grep -c x", None, "exact", "capture"), ("grep --context=3 x", None, "exact", "capture"), ("cat a.rs", "outline", "", "capture"), ("cat -n a.rs", None, "exact", "capture"),
    ("rg --json x", None, "machine", "capture"), ("rg -rX y", None, "machine", "capture"), ("kubectl get pods", "kubectl_pods", "", "capture"), ("kubectl get pods -ojson", None, "machine", "capture"), ("kubectl logs -f x", "service_logs", "", "stream"), ("helm get all x", None, "machine", "capture"), ("docker ps", "docker_ps", "", "capture"), ("docker ps -q", None, "machine", "capture"), ("docker image inspect x", None, "machine", "capture"),
    ("docker build --progress rawjson .", None, "machine", "capture"), ("docker run x", "columns", "", "inherit"), ("docker stats", "columns", "", "inherit"), ("docker stats --no-stream", "docker_stats", "", "capture"), ("docker compose ps", "docker_ps", "", "capture"), ("docker compose config", None, "machine", "capture"), ("docker logs --follow x", "service_logs", "", "stream"), ("aws s3 ls --query x", None, "machine", "capture"), ("jq .", None, "machine", "capture"),
    ("psql -c select", "psql", "", "capture"), ("psql -At", None, "machine", "inherit"), ("psql -c copy", None, "exact", "capture"), ("systemctl show x", None, "machine", "capture"), ("ps -o pid", None, "machine", "capture"), ("npm ls", "package_tree", "", "capture"), ("npm ls --json", None, "machine", "capture"), ("npm run dev", None, "", "inherit"), ("npm ci", "install", "", "capture"), ("pnpm outdated --format table", None, "machine", "capture"),
    ("pip freeze", None, "exact", "capture"), ("pip install x", "pip_install", "", "capture"), ("uv sync", "uv", "", "capture"), ("gh pr view 1", "gh_view", "", "capture"), ("gh pr view --jq .x", None, "machine", "capture"), ("gh run watch 1", "columns", "", "stream"), ("gh run list", "gh_run_list", "", "capture"), ("sqlite3 -csv x", None, "machine", "capture"), ("sqlite3 x.db", "sqlite_table", "", "capture"),
    ("curl -v http://x", "curl", "", "capture"), ("curl -vv http://x", None, "exact", "capture"), ("curl -w%{x} http://x", None, "exact", "capture"), ("vite build", "frontend_build", "", "capture"), ("vite", None, "", "inherit"), ("esbuild --serve", "esbuild", "", "inherit"), ("make all", "native_build", "", "capture"), ("make --help", None, "query", "capture"), ("mypy --output json", None, "query", "capture"), ("ruff rule E1", None, "query", "capture"),
    ("git status --short", "git_status_short", "", "capture"), ("git status --porcelain=v2", None, "", "capture"), ("git log --oneline", None, "", "capture"), ("git show HEAD:f", None, "", "capture"), ("git branch -vv", "git_branch", "", "capture"),
    ("git branch", "git_branches", "", "capture"), ("git blame -s f", None, "", "capture"), ("git reflog", "git_reflog", "", "capture"), ("git config --list", "trimmed", "", "capture"), ("git config user.name", None, "", "capture"), ("git remote -v", "git_remotes", "", "capture"),
    ("git worktree list", "git_worktrees", "", "capture"), ("git add .", "git_add", "", "capture"), ("git diff --stat", None, "", "capture"), ("tsc", "tsc", "", "capture"), ("grep -rn x a b", "grep", "", "capture"), ("rg x", "rg_matches", "", "capture"), ("find . -type f", "find_files", "", "capture"),
    ("docker logs a", "service_logs", "", "capture"), ("docker compose logs", "compose_logs", "", "capture"), ("docker build .", "buildkit", "", "capture"), ("gh pr checks 1", "gh_checks", "", "capture"), ("gh pr list --json a", "json", "", "capture"), ("pip list", "pip_table", "", "capture"), ("helm list", "helm_list", "", "capture"),
    ("helm status x", "helm_status", "", "capture"), ("cmake --build .", "cmake", "", "capture"), ("ctest", "ctest", "", "capture"), ("dotnet build", "dotnet", "", "capture"), ("xcodebuild", "swift", "", "capture"), ("pre-commit run", "pre_commit", "", "capture"), ("npm test", "script_test", "", "capture"), ("ps aux", "columns", "", "capture"),
    ("aws ec2 x --output table", "grid", "machine", "capture"), ("ruff check", "ruff", "", "capture"), ("golangci-lint run --out-format=json", None, "exact", "capture"), ("golangci-lint run", "golangci_lint", "", "capture"), ("dotnet build -getProperty:x", None, "query", "capture"), ("dotnet test -l trx", None, "exact", "capture"), ("terraform plan", "plan", "", "capture"), ("terraform plan --json", None, "query", "capture"), ("prettier --write x", "prettier", "", "capture"), ("ctest --show-only=json", None, "exact", "capture"), ("nodemon x", None, "", "inherit"),
)

#: (command line; what runs behind its runners, and their names; None where that cannot be told)
RUNS = (
    ("uv run pytest -q", "pytest -q", "uv run"), ("uv run --python 3.12 -- pytest", "pytest", "uv run"), ("uvx --from x ruff check", "ruff check", "uvx"), ("poetry -q run mypy .", "mypy .", "poetry run"), ("pnpm -r exec jest", "jest", "pnpm exec"), ("npx -y eslint .", "eslint .", "npx"), ("npx -c x", None, None), ("bunx --bun vite build", "vite build", "bunx"),
    ("uv run poetry run pnpm exec npx jest", "jest", "uv run > poetry run > pnpm exec > npx"), ("uv run uvx npx bunx uvx jest", None, None), ("uv run --strange x", None, None), ("uv sync", "uv sync", ""), ("git status", "git status", ""), ("npx --package=a b", "b", "npx"), ("poetry install", None, None), ("pnpm install", "pnpm install", ""),
)

#: (text; its words by a slash or None, whether it only reads; the programs that run, by a slash, or None)
TEXTS = (
    ("git log 'a b'", "git/log/a b", True, "git"), ("ls -l | wc", None, False, "ls/wc"), ("find . -delete", "find/./-delete", False, "find"), ("rg --pre x y", "rg/--pre/x/y", False, "rg"), ("cat \"a\\\"b\"", "cat/a\"b", True, "cat"), ("echo $HOME", None, False, "echo"), ("git --no-pager diff", "git/--no-pager/diff", True, "git"), ("git log --pretty=x", "git/log/--pretty=x", False, "git"),
    ("FOO=1 env X=2 pytest -q && bash -c 'git status; ls'", None, False, "pytest/git/ls"), ("if true; then x; fi", None, False, None), ("cd x && make", None, False, "make"), ("echo \"open", None, False, None), ("/bin/ls a", "/bin/ls/a", False, "ls"), ("command exec du -s", "command/exec/du/-s", False, "du"),
)

#: (script whose captures a command printed, the command line): by their own command, or by a shell, where content must tell.
CAPTURED = (
    ("git_status", "git status"), ("git_status", "sh -c x"), ("git_log", "bash -c x"), ("git_diff", "zsh -c x"), ("git_show", "sh -c x"), ("git_commit", "sh -c x"), ("git_merge", "sh -c x"), ("cargo_test", "sh -c x"), ("jest", "sh -c x"), ("go_test", "sh -c x"), ("ls_long", "sh -c x"),
    ("tree", "sh -c x"), ("composer_install", "sh -c x"), ("mypy", "mypy ."), ("mypy", "mypy --output=x"), ("prettier", "prettier --write ."), ("gh_view", "gh pr view 3"), ("gh_view", "gh pr view 3 --jq .x"),
)

#: (script, the command line, exit code, whether its compact form is shown): captures of all families through one registry, behind runners, of commands that
#: failed, and of commands whose output is of another kind.
REGISTERED = (
    ("git_status", "git status", 0, True),
    ("git_status", "git status --porcelain=v2", 0, False),
    ("git_log", "git log -3", 0, True),
    ("git_log", "git log --oneline", 0, False),
    ("git_log", "git log", 1, False),
    ("git_log", "git status", 0, False),
    ("git_diff", "git diff", 0, True),
    ("git_config", "git config --list", 0, True),
    ("git_remotes", "git remote -v", 0, True),
    ("git_shortlog", "git shortlog -sn", 0, True),
    ("git_worktrees", "git worktree list", 0, True),
    ("git_add", "git add .", 0, True),
    ("cargo_test", "cargo test", 1, True),
    ("jest", "npx -y jest", 0, True),
    ("pytest", "uv run --python 3 pytest -q", 0, True),
    ("git_config", "pytest", 1, False),
    ("native_build", "make", 2, True),
    ("pip_install", "pip install x", 1, False),
    ("ls_long", "sh -c x", 0, True),
    ("helm_list", "helm list", 0, True),
    ("helm_history", "helm history x", 0, True),
    ("helm_status", "helm status x", 0, True),
    ("helm_status", "helm status x", 1, False),
    ("docker_stats", "docker stats --no-stream", 0, True),
    ("psql_rows", "psql -c x", 0, True),
    ("mypy", "poetry run mypy .", 1, True),
    ("pre_commit", "pre-commit run", 1, True),
    ("gh_view", "gh pr view 3 --jq .x", 0, False),
)
