"""Column functions over keys, requests, settings, log lines and source text. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import byte_values, hash31, text_of_hex

# Substrings that a safe SQL text must not hold, and characters that a safe command must not hold.
UNSAFE_SQL = ("'", "--", ";", "/*", "*/", "DROP", "DELETE")
UNSAFE_COMMAND = ("|", "&", ";", "`", "$", "(", ")", "{", "}")
# Names of log levels 0 to 3.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")
#: Languages by file extension.
LANGUAGES = {"c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java"}


def _xored(values: Column, key: str) -> Column:
    if not key:
        raise ValueError("the key is empty")
    codes = F.array(*[F.lit(b) for b in key.encode()])
    parts = F.transform(values, lambda b, i: F.lpad(F.hex(b.bitwiseXOR(F.get(codes, i % len(key.encode()))).cast("long")), 2, "0"))
    return F.array_join(parts, "")


def xor_hex(x: Column, key: str) -> Column:
    """The UTF-8 bytes of a text, each XORed with the repeating key, in hexadecimal; empty stays empty."""
    return F.lower(_xored(byte_values(x), key))


def xor_back(x: Column, key: str) -> Column:
    """The text whose ``xor_hex`` is given."""
    values = F.transform(F.regexp_extract_all(F.upper(x), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))
    return text_of_hex(_xored(values, key))


def hash_hex(x: Column, width: int = 16) -> Column:
    """``hash31`` as hexadecimal digits, padded on the left."""
    return F.lpad(F.lower(F.conv(hash31(x).cast("string"), 10, 16)), width, "0")


def derived_key(password: Column, salt: Column) -> Column:
    """Null without a password; a null salt counts as empty."""
    return F.when(password.isNotNull(), hash_hex(F.concat(password, F.coalesce(salt, F.lit(""))), 32))


def signature(data: Column, key: Column) -> Column:
    return hash_hex(F.concat(key, data))


def verified(data: Column, given: Column, key: Column) -> Column:
    return F.coalesce(signature(data, key) == given, F.lit(False))


def cache_slot(x: Column, slots: int = 256) -> Column:
    return (hash31(x, 32) % slots).cast("int")


def spaced_hex(prefix: str, x: Column) -> Column:
    return F.concat(F.lit(f"{prefix}: "), F.regexp_replace(F.lower(F.hex(x)), "(..)", "$1 "))


def is_safe_sql(x: Column) -> Column:
    """Null is safe."""
    found = F.lit(False)
    for part in UNSAFE_SQL:
        found = found | F.contains(x, F.lit(part))
    return F.coalesce(~found, F.lit(True))


def is_safe_command(x: Column) -> Column:
    """Null is not safe."""
    return F.coalesce(F.translate(x, "".join(UNSAFE_COMMAND), "") == x, F.lit(False))


def within(size: Column, offset: Column, length: Column) -> Column:
    return offset + length <= size


def product_fits(count: Column, size: Column) -> Column:
    """Whether the product of two counts fits in 64 unsigned bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return wide(count) * wide(size) < F.lit(str(2**64)).cast("decimal(20,0)")


def input_code(x: Column, most: int = 100) -> Column:
    return F.when(x.isNull(), -1).when(F.octet_length(x) > most, -2).otherwise(0)


def request(raw: Column) -> Column:
    """method, path and body of a request; null without a line end. The body follows the first blank line."""
    end = F.locate("\r\n\r\n", raw)
    word = lambda i: F.regexp_extract(raw, r"^\s*(\S+)\s+(\S+)", i)
    body = F.when(end > 0, F.substring(raw, end + 4, F.length(raw))).otherwise("")
    return F.when(F.contains(raw, F.lit("\r\n")), F.struct(word(1).alias("method"), word(2).alias("path"), body.alias("body")))


def route_status(method: Column, path: Column) -> Column:
    """Status of a request as far as method and path decide it; null where a body or a file does."""
    by_content = (method == "GET") & F.startswith(path, F.lit("/file/")) | (method == "POST") & path.isin("/login", "/exec", "/upload")
    return F.when(by_content, F.lit(None).cast("int")).when((method == "GET") & (path == "/status"), 200).when(method.isin("GET", "POST"), 404).otherwise(405)


def expand_env(x: Column, names: dict[str, str]) -> Column:
    """``${NAME}`` becomes its value or nothing, ``${NAME:-value}`` falls back on the given one."""
    known = F.create_map(*[F.lit(v) for kv in names.items() for v in kv]) if names else F.create_map(F.lit(""), F.lit(""))
    parts = F.array_distinct(F.regexp_extract_all(x, F.lit(r"\$\{([^}]*)\}"), F.lit(1)))
    value = lambda p: F.coalesce(F.try_element_at(known, F.regexp_replace(p, ":-.*$", "")), F.regexp_extract(p, ":-(.*)$", 1))
    return F.aggregate(parts, x, lambda text, p: F.replace(text, F.concat(F.lit("$"), F.lit("{"), p, F.lit("}")), value(p)))


def log_line(time: Column, level: Column, message: Column) -> Column:
    name = F.coalesce(*[F.when(level == i, F.lit(n)) for i, n in enumerate(LEVELS)], F.lit("UNKNOWN"))
    return F.concat(F.lit("["), time.cast("string"), F.lit("] "), name, F.lit(": "), message)


def log_context(file: Column, line: Column, function: Column, message: Column) -> Column:
    """A message with the place it comes from in front."""
    return F.concat(F.lit("["), file, F.lit(":"), line.cast("string"), F.lit(" "), function, F.lit("()] "), message)


def secure_equal(a: Column, b: Column) -> Column:
    """Equality of two texts; null equals nothing."""
    return F.coalesce(a == b, F.lit(False))


def random_token(length: int) -> Column:
    """Random letters and digits, others for each row."""
    return F.randstr(F.lit(length))


def command_code(x: Column) -> Column:
    """1, 2 and 0 for the three known commands, -1 for any other."""
    # The commands and their codes.
    return F.when(x == "GET_STATUS", 1).when(x == "GET_CONFIG", 2).when(x == "SHUTDOWN", 0).otherwise(-1)


def admin_steps(x: Column) -> Column:
    """The numbers below 100 that an admin command of more than ten characters handles: multiples of 2, 3 and 5."""
    steps = F.filter(F.sequence(F.lit(0), F.lit(99)), lambda i: (i % 2 == 0) & (i % 3 == 0) & (i % 5 == 0))
    return F.when(F.startswith(x, F.lit("ADMIN")) & (F.octet_length(x) > 10), steps).otherwise(F.array().cast("array<int>"))


def request_response(method: Column, path: Column, body: Column, users: dict[str, str], files: dict[str, str], connections: Column) -> Column:
    """Response of a request, as far as tables of users and files and the number of connections decide it; null where the reference sends nothing new.

    Files are served up to 2047 characters, uploads are acknowledged, nothing is ever run.
    """
    text = lambda code, words, content: F.concat(F.lit(f"HTTP/1.1 {code} {words}\r\n"), content)
    table = lambda t: F.create_map(*[F.lit(v) for kv in t.items() for v in kv]) if t else F.create_map(F.lit(""), F.lit(None).cast("string"))
    content = F.left(F.try_element_at(table(files), F.substring(path, F.lit(7), F.length(path))), F.lit(2047))
    found = text(200, "OK", F.concat(F.lit("Content-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"), content))
    gone = text(404, "Not Found", F.lit("\r\nFile not found"))
    user, password = F.regexp_extract(body, r"^user=(\S{1,63})&pass=(\S{1,63})", 1), F.regexp_extract(body, r"^user=(\S{1,63})&pass=(\S{1,63})", 2)
    login = F.when(password == "", F.lit(None)).when(F.coalesce(F.try_element_at(table(users), user) == password, F.lit(False)), text(200, "OK", F.lit("\r\nLogin successful"))).otherwise(text(401, "Unauthorized", F.lit("\r\nInvalid credentials")))
    upload = F.when(body.rlike("^filename=\\S+") & F.contains(body, F.lit("&content=")), text(200, "OK", F.lit("\r\nFile saved")))
    get = F.when(F.startswith(path, F.lit("/file/")), F.when(content.isNotNull(), found).otherwise(gone)).when(path == "/status", text(200, "OK", F.concat(F.lit("\r\nServer running, connections: "), connections.cast("string"))))
    post = F.when(path == "/login", login).when(path == "/upload", upload).when(path == "/exec", F.lit(None).cast("string"))
    other = text(404, "Not Found", F.lit("\r\nNot found"))
    get = F.when(F.startswith(path, F.lit("/file/")) | (path == "/status"), get).otherwise(other)
    post = F.when(path.isin("/login", "/upload", "/exec"), post).otherwise(other)
    return F.when(method == "GET", get).when(method == "POST", post).otherwise(text(405, "Method Not Allowed", F.lit("\r\n")))


def preview(x: Column, most: int = 200) -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("..."))).otherwise(x)


def path_parts(path: Column) -> Column:
    """filename, extension, module (the folder below the first) and language of a path; null where there is none."""
    name = F.substring_index(path, "/", -1)
    extension = F.nullif(F.regexp_extract(name, r"\.([^.]+)$", 1), F.lit(""))
    folders = F.split(path, "/")
    module = F.when(F.size(folders) > 2, F.get(folders, F.lit(1)))
    language = F.coalesce(*[F.when(extension == e, F.lit(n)) for e, n in LANGUAGES.items()])
    return F.struct(name.alias("filename"), extension.alias("extension"), module.alias("module"), language.alias("language"))


def line_counts(content: Column, comment: str = r"^\s*(//|#)") -> Column:
    """total, blank, comment and code lines; a last line end opens no line. Comments are lines that begin with a mark."""
    lines = F.split(F.regexp_replace(content, r"\n\z", ""), "\n", -1)
    n = F.when(content == "", 0).otherwise(F.size(lines))
    blank = F.when(content == "", 0).otherwise(F.size(F.filter(lines, lambda x: x.rlike(r"^\s*$"))))
    marked = F.size(F.filter(lines, lambda x: x.rlike(comment)))
    return F.when(content.isNotNull(), F.struct(n.alias("total"), blank.alias("blank"), marked.alias("comment"), (n - blank - marked).alias("code")))
