"""Command catalogs as small tables. All lists here are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Commands that are wrapped by themselves.
AUTO_WRAP = (
    "acli", "aws", "bat", "batcat", "biome", "brew", "bun", "bunx", "cargo", "cat", "cmake", "composer", "ctest",
    "curl", "df", "diff", "docker", "docker-compose", "dotnet", "du", "esbuild", "eslint", "find", "gh", "git",
    "go", "golangci-lint", "gradle", "gradlew", "grep", "gt", "head", "helm", "jest", "jq", "kubectl", "ls",
    "lsof", "make", "mocha", "mvn", "mvnw", "mypy", "next", "ninja", "npm", "pip", "pip3", "playwright", "pnpm",
    "pre-commit", "prisma", "ps", "psql", "pup", "pytest", "rake", "rg", "rspec", "rubocop", "ruff", "sqlite3",
    "systemctl", "tail", "terraform", "tofu", "tree", "tsc", "uv", "uvx", "vite", "vitest", "wc", "webpack",
    "yarn", "zig",
)
#: Commands that are only wrapped on request.
ON_REQUEST = ("bash", "env", "node", "prettier", "sh", "swift", "turbo", "xcodebuild", "zsh")
WRAPPER = sorted([*AUTO_WRAP, *ON_REQUEST])
GIT_SUBCOMMANDS = (
    "add", "blame", "branch", "checkout", "commit", "config", "diff", "fetch", "grep", "log", "merge", "pull",
    "push", "remote", "rebase", "reflog", "shortlog", "show", "stash", "status", "switch", "tag", "worktree",
)
RUNNERS = ("uv run", "uvx", "poetry run", "pnpm exec", "npx", "bunx")
FAMILIES = {
    "git": (
        "git", "gt",
    ),
    "test-tools": (
        "pytest", "jest", "vitest", "mocha", "ctest", "playwright", "tsc", "cargo", "go", "rspec", "dotnet", "node",
        "npm", "pnpm", "yarn", "bun",
    ),
    "listing": (
        "find", "tree", "ls", "du", "wc", "env", "rg", "grep", "bat", "batcat", "diff", "head", "tail",
    ),
    "build": (
        "make", "ninja", "cargo", "go", "zig", "npm", "pnpm", "yarn", "bun", "webpack", "vite", "esbuild", "cmake",
        "docker", "docker-compose", "turbo", "next", "dotnet", "prisma", "rake", "gradle", "gradlew", "mvn", "mvnw",
        "swift", "xcodebuild", "uv", "uvx", "poetry", "npx", "bunx",
    ),
    "package": (
        "npm", "pnpm", "yarn", "bun", "composer", "pip", "pip3", "uv", "uvx",
    ),
    "infra": (
        "curl", "docker", "docker-compose", "kubectl", "helm", "gh", "acli",
    ),
    "data": (
        "aws", "jq", "pup", "acli", "gh", "sqlite3", "cat", "docker", "docker-compose", "kubectl", "ps", "df", "psql",
        "systemctl", "lsof", "npm", "pnpm", "yarn", "brew", "bun", "bat", "batcat",
    ),
    "diagnostics": (
        "mypy", "ruff", "golangci-lint", "rubocop", "eslint", "biome", "pre-commit", "prettier", "terraform", "tofu",
    ),
}
EXEMPT = ("bash", "sh", "zsh", "env")


def commands(spark: SparkSession) -> DataFrame:
    """command, auto_wrap, wrapper."""
    return spark.createDataFrame([(c, c in AUTO_WRAP, True) for c in WRAPPER], "command string, auto_wrap boolean, wrapper boolean")


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, c) for f, cs in FAMILIES.items() for c in cs], "family string, command string")


def uncovered(spark: SparkSession) -> DataFrame:
    """Catalogued commands that no family takes, and family members that are not catalogued."""
    from pyspark.sql import functions as F

    names, own = commands(spark).select("command"), families(spark)
    lost = names.where(~F.col("command").isin(*EXEMPT)).join(own, "command", "left_anti").select("command", F.lit("no family").alias("gap"))
    return lost.unionByName(own.select("command").distinct().join(names, "command", "left_anti").select("command", F.lit("not catalogued").alias("gap")))
