"""Rules that come with the library: those that regular expressions tell whole. Patterns and paths are fixed values."""

from __future__ import annotations

from sieveworks.plans.rules import RegexRule

_TESTS = ("*.test.*", "*.spec.*", "*.stories.*", "*_test.*", "test/**", "tests/**", "__tests__/**", "__mocks__/**", "**/mocks/**", "**/fixtures/**", "**/seed/**", "**/seeds/**", "**/scripts/**")
_SERVERS = ("app.js", "app.ts", "index.js", "index.ts", "server.js", "server.ts", "node_promise.ts", "**/api/**", "**/controllers/**", "**/jobs/**", "**/routes/**", "**/scripts/**", "**/server/**", "**/workers/**")
_SLOP = r"(as an ai\b|as a language model|your code here|implementation goes here|rest of (the |your )?(code|implementation|logic)|\.\.\.\s*(unchanged|existing code)|(todo|fixme)s?\s*:?\s*implement)"

SHIPPED = (
    RegexRule("general.mock-data-in-production", r"""(?i)(import\s+[^;]*from\s+['"]@faker-js/faker['"]|require\(\s*['"]@faker-js/faker['"]\s*\)|from\s+['"]faker['"])""", "warning", "bug", "A library of made-up data is imported outside of tests.", "hint", exclude=_TESTS),
    RegexRule("general.node-unhandled-promise-rejection", r"(?m)^[ \t]*(?:fetch\([^;\n]*\)|Promise\.reject\([^;\n]*\)|[A-Za-z_$][A-Za-z0-9_$]*(?:\([^;\n]*\))?\.then\([^;\n]*\));[ \t]*(?://[^\n]*)?$", "warning", "bug", "A promise is neither awaited, returned nor caught.", "hint", include=_SERVERS),
    RegexRule("general.placeholder-or-ai-slop-comment", rf"(?i)((?<!:)//|/\*)\s*.*?{_SLOP}", "warning", "quality", "A comment stands where code is missing.", "hint"),
    RegexRule("general.regex-dos-candidate", r"/\([^)]+[+*]\)[+*]/|new RegExp\(['\"`][^'\"`]*\([^)]+[+*]\)[+*][^'\"`]*['\"`]\)", "warning", "security", "A repeated group repeats its own content: matching may take exponential time.", "hint"),
    RegexRule("general.ts-ignore-without-reason", r"(?m)//\s*@ts-ignore\s*$", "warning", "quality", "The type checker is silenced without a reason.", "hint"),
    RegexRule("general.zod-v4-no-deprecated-error-customization", r"z\.\w+\(\s*\{[^}]*\berrorMap\b", "warning", "quality", "errorMap is called error since version 4.", "rule"),
    RegexRule("rn.rn-no-deep-imports", r"""from\s+['"]react-native/Libraries/""", "warning", "quality", "An internal path of the library is imported.", "rule"),
    RegexRule("rn.rn-no-non-native-navigator", r"""from\s+['"]@react-navigation/stack['"]""", "warning", "performance", "The navigator animates on the script's thread; there is a native one.", "rule"),
    RegexRule("tanstack.query-no-rest-destructuring", r"const\s*\{[^}]*\.\.\.\s*[A-Za-z_$][A-Za-z0-9_$]*\s*\}\s*=\s*use(?:Query|InfiniteQuery|SuspenseQuery|SuspenseInfiniteQuery)\s*\(", "info", "performance", "The rest of a query's result subscribes to every change.", "hint"),
)
