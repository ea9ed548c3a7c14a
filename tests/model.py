"""Plain Python statements of the line semantics, used as test oracles."""

import re

PAIRS = {'"': '"', "[": "]", "{": "}", "<": ">"}
GAP = re.compile(r"[\w\s.]+")


def signature(line):
    tokens, stack, run = [], [], ""

    def flush():
        if run == "...":
            tokens.append(run)
        else:
            tokens.extend(run)

    for sym in (c for c in line if not (c.isalnum() or c == "_" or c.isspace())):
        if stack and PAIRS[stack[-1]] == sym:
            opener = stack.pop()
            if not stack:
                tokens.append(opener + "X" + sym)
                run = ""
        elif sym in PAIRS:
            if not stack:
                flush()
                run = ""
            stack.append(sym)
        elif sym not in "]}>" and not stack:
            run += sym
    if not stack:
        flush()
    return " ".join(tokens)


def kinds(pattern):
    parsed = []
    for token in pattern.split():
        body = token.replace("X", "")
        if token == "X":
            parsed.append(("complex_content", "", ""))
        elif "X" not in token:
            if not any(c.isalnum() or c == "_" for c in token):
                parsed.append(("symbol", token, ""))
        else:
            parsed.append(("enclosed_content", body[:1], body[-1] if len(body) > 1 else ""))
    return parsed


def _seek(line, needles, start):
    hits = (line.find(n, start) for n in needles)
    return next((h for h in hits if h >= 0), -1)


def walk(line, pattern):
    """(is enclosed, text) for every extracted field."""
    if not line or not pattern:
        return []
    tokens, out, at = kinds(pattern), [], 0

    def keep(enclosed, text):
        if text.strip():
            out.append((enclosed, text.strip()))

    if tokens:
        at = max(_seek(line, tokens[0][1], 0), 0)
        keep(False, line[:at])
    for i, (kind, needles, closer) in enumerate(tokens):
        if kind == "symbol":
            hit = _seek(line, needles, at)
            at = hit + 1 if hit >= 0 else at
        elif kind == "enclosed_content":
            begin = _seek(line, needles, at) if closer else -1
            end = line.find(closer, begin + 1) if begin >= 0 else -1
            if end >= 0:
                out.append((True, line[begin + 1 : end]))
                at = end + 1
        else:
            hits = (_seek(line, n, at) for _, n, _ in tokens[i + 1 :])
            end = next((h for h in hits if h >= 0), len(line))
            keep(True, line[at:end])
            at = end
        if i + 1 < len(tokens):
            hit = _seek(line, tokens[i + 1][1], at)
            end = hit if hit >= 0 else len(line)
            gap = line[at:end].strip()
            if gap and GAP.fullmatch(gap):
                out.append((False, gap))
                at = end
    keep(False, line[at:])
    return out


def shallow(line, pattern):
    if not line or not pattern:
        return ""
    tokens, out = pattern.split(), []

    def parts(token):
        if token in ('"X"', "[X]", "{X}", "<X>"):
            return token[0], token[2]
        if "X" not in token and not any(c.isalnum() or c == "_" for c in token):
            return token, ""
        return "", ""

    def keep(text):
        if text.strip():
            out.append(text.strip())

    at = max(_seek(line, parts(tokens[0])[0], 0), 0) if tokens else 0
    if tokens:
        keep(line[:at])
    for i, token in enumerate(tokens):
        needles, closer = parts(token)
        out.append(token)
        hit = _seek(line, needles, at)
        if hit >= 0:
            at = hit + 1
            if closer:
                end = line.find(closer, at)
                at = end + 1 if end >= 0 else len(line)
        if i + 1 < len(tokens):
            hit = _seek(line, parts(tokens[i + 1])[0], at)
            end = hit if hit >= 0 else len(line)
            keep(line[at:end])
            at = end
    keep(line[at:])
    return " ".join(out)
