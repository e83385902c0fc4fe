"""Fixed values of the detection contract, and the Java patterns built from them."""

from __future__ import annotations

# Unicode classes: a word character is a letter, a number or an underscore (combining marks are not), white space includes
# the separators that Java's \s leaves out.
W = r"\p{L}\p{N}_"
S = r"\s\x1c-\x1f\x85\p{Z}"
D = r"\p{Nd}"

# ---- fixed values: public names and networks that are never replaced -------------------------------------------------
SAFE_EXACT = (
    "localhost", "127.0.0.1", "0.0.0.0", "::1", "example.com", "example.org", "example.net",
    "user@example.com", "test@example.com", "noreply@example.com", "john.doe@example.com",
)
SAFE_SUFFIXES = (".example", ".test", ".invalid", ".localhost")
SAFE_NETS = (
    "127.0.0.0/8", "0.0.0.0/32", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24",
    "8.8.8.8/32", "8.8.4.4/32", "1.1.1.1/32", "1.0.0.1/32", "9.9.9.9/32", "255.255.255.255/32",
)

# ---- fixed values: last labels of host names, and endings that are file names ----------------------------------------
HOST_TLDS = (
    "com org net edu gov mil int eu "
    "it ch fr de es pt nl uk ie dk se fi pl cz sk hu ro gr hr si rs bg lt lv ee mt cy lu us ca "
    "mx br ar cl au nz jp cn kr sg za tr ru ua il ae sa eg al ba mk ge am az kz md "
    "local lan internal intranet corp azienda"
).split()
FILE_ENDINGS = (
    "py pyc pyi ts tsx js jsx mjs cjs json json5 md markdown txt text rst yaml yml toml ini cfg conf env "
    "log csv tsv xml html htm css scss less sh bash zsh fish ps1 bat cmd c h cc cpp hpp cs java kt go "
    "rs rb php pl lua swift scala sql db sqlite lock map png jpg jpeg gif webp bmp svg ico pdf doc docx xls "
    "xlsx ppt pptx odt ods odp rtf epub zip tar gz tgz bz2 xz 7z rar dmg exe msi deb rpm bin iso img "
    "mp3 mp4 mov avi mkv wav flac ttf otf woff woff2 plist service patch diff bak tmp old orig example am"
).split()

# ---- fixed values: secrets that are only placeholders ------------------------------------------------------------------
DUMMY_SECRETS = (
    "changeme", "change-me", "change_me", "changed", "placeholder", "redacted", "dummy", "example", "sample", "fake",
    "none", "null", "nil", "todo", "secret", "password", "your", "your-password", "your-secret", "your-token", "your-key",
    "your-api-key", "your-api-key-here", "your-key-here", "your-token-here", "your-secret-here", "see-above", "see-below",
    "see-above-", "n-a", "na", "unknown", "not-set", "notset", "xxx", "xxxx", "xxxxx", "xxxxx xxxxx", "test", "testing",
    "local", "dev",
)
DUMMY_PREFIX = r"^(?:your|placeholder|example|sample|dummy|fake|changeme|change|secret|password|token|key|xxx|todo|none|null|not|see)(?:[-_.]|$)"
VARIABLE_STARTS = ("<", "${", "{{", "%(", "[", "@")
BLANK_SECRET = r"^[*._\- ]*$"

# ---- fixed values: check characters of the Italian tax code ------------------------------------------------------------
# Values at odd places of 0-9 and A-Z; at even places a digit counts itself and a letter its place in the alphabet.
CF_ODD = {
    **dict(zip("0123456789", (1, 0, 5, 7, 9, 13, 15, 17, 19, 21), strict=True)),
    **dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23), strict=True)),
}
CF_FORMAT = r"[A-Z]{6}[0-9LMNPQRSTUV]{2}[ABCDEHLMPRST][0-9LMNPQRSTUV]{2}[A-Z][0-9LMNPQRSTUV]{3}[A-Z]"
CF_LETTERS, CF_DIGITS = "LMNPQRSTUV", "0123456789"
IBAN_FORMAT = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
PLATE_FORMAT = rf"[A-Z]{{2}}{'[' + D + ']'}{{3}}[A-Z]{{2}}"

# ---- fixed values: postal addresses ---------------------------------------------------------------------------------------
STREET_WORDS = r"(?:via|viale|v\.?le|piazza|piazzale|p\.?zza|p\.?za|corso|strada|vicolo|largo|lungomare|traversa|borgo|stradone|salita)"
STREET_NAME = rf"[\p{{L}}\p{{Nl}}\p{{No}}][{W}'’.\-]*(?:[{S}]+[{W}'’.\-]+){{0,4}}?"
ADDRESS = rf"(?iu)(?<![{W}]){STREET_WORDS}[{S}]+({STREET_NAME})[,{S}]+(?:n\.?[{S}]*)?([{D}]{{1,4}})(?:[{S}]*[/\-][{S}]*[A-Za-z0-9]{{1,3}})?(?![{W}])"
ELIDED = (
    "un uno una il lo la l gli le i del dello della dei degli delle al allo alla ai agli alle dal dallo dalla dai dagli dalle "
    "nel nello nella nei negli nelle sul sullo sulla sui sugli sulle col coi coll quest quell bell grand sant tutt mezz d c"
).split()

# ---- fixed values: the other patterns ---------------------------------------------------------------------------------------
PLACEHOLDER = r"\[[A-Z][A-Z0-9_]*-[\p{Nd}]+(?:-[0-9a-f]{4,8})?\]"
URL = rf"(?iu)(?:(?:https?|ftp|sftp)://|www\.)[^{S}<>\"'()\[\]{{}}]+"
URL_TRIM = ".,;:!?)]}»\"'"
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?"
EMAIL = rf"[A-Za-z0-9._%+\-]{{1,64}}@{LABEL}(?:\.{LABEL}){{1,10}}"
_B = rf"(?:(?<![{W}])(?=[{W}])|(?<=[{W}])(?![{W}]))"
JWT = rf"{_B}eyJ[A-Za-z0-9_\-]{{5,}}\.[A-Za-z0-9_\-]{{5,}}\.[A-Za-z0-9_\-]{{5,}}{_B}"
KEY_SK = rf"{_B}sk-[A-Za-z0-9_\-]{{16,}}{_B}"
KEY_AWS = rf"{_B}AKIA[0-9A-Z]{{16}}{_B}"
KEY_GH = rf"{_B}ghp_[A-Za-z0-9]{{20,}}{_B}"
KEY_GH_PAT = rf"{_B}github_pat_[A-Za-z0-9_]{{20,}}{_B}"
KEY_SLACK = rf"{_B}xox[baprs]-[A-Za-z0-9\-]{{10,}}{_B}"
BEARER = rf"(?iu)bearer[{S}]+([A-Za-z0-9._\-]{{20,}})"
ASSIGNED = (
    r"(?:(?iu)(?<![A-Za-z0-9])(?:[A-Za-z0-9]+[_-])?(?:api[_-]?key|apikey|secret|client[_-]?secret|password|passwd|pwd|token|access[_-]?token|refresh[_-]?token)"
    rf"{_B}[{S}]*[:=][{S}]*[\"']?)([A-Za-z0-9._\-+/=]{{8,}})(?![A-Za-z0-9._\-+/=])(?!\()"
)
CODICE_FISCALE = rf"(?iu)(?<![{W}]){CF_FORMAT}(?![{W}])"
PARTITA_IVA = rf"(?iu)(?<![{D}.])(?:IT)?[{S}]?([{D}]{{11}})(?![{D}])"
IBAN = rf"(?iu)(?<![{W}])IT[{S}]?[{D}]{{2}}[{S}]?[A-Z][{S}]?(?:[A-Z0-9][{S}]?){{10,30}}(?![{W}])"
PLATE = rf"(?<![{W}])[A-Z]{{2}}[{S}]?[{D}]{{3}}[{S}]?[A-Z]{{2}}(?![{W}])"
IPV4 = rf"(?<![{W}.])(?:[{D}]{{1,3}}\.){{3}}[{D}]{{1,3}}(?![{W}])(?!\.[{W}])"
IPV6 = rf"(?<![{W}:])(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{0,4}}(?![{W}:])"
PHONE = (
    rf"(?<![{W}.])(?:\+[{D}]{{1,3}}[{S}.\-/]?[{D}]{{2,4}}[{S}.\-/]?[{D}]{{3,4}}[{S}.\-/]?[{D}]{{2,4}}"
    rf"|0039[{S}.\-/]?[{D}]{{5,12}}|3[{D}]{{2}}[{S}.\-/]?[{D}]{{3,4}}[{S}.\-/]?[{D}]{{3}})(?![{W}])"
)
HOST = rf"(?<![{W}.\-])(?:{LABEL}\.)+[A-Za-z]{{2,63}}(?![{W}\-])(?!\.[{W}])"

# ---- fixed values: names in a dictionary --------------------------------------------------------------------------------------
LEGAL_FORM = (
    r"(?:s\.?\s?r\.?\s?l\.?\s?s?|s\.?\s?p\.?\s?a\.?|s\.?\s?n\.?\s?c\.?|s\.?\s?a\.?\s?s\.?|s\.?\s?a\.?|s\.?\s?s\.?"
    r"|ltd|llc|inc|gmbh|ag|bv|nv|sarl|sàrl|sl|oy|ab|aps|pte|pty|corp|kg|ug|sro|doo|ooo|plc|llp|ltda|eirl|slu|sagl|sr[l]?|&\s?c\.?|e\s?c\.)"
)
NAME_GAP = rf"[{S}.\-_'’,]+"
WORD_RUN = rf"[{W}]+"
NEAR_WORD = rf"[\p{{L}}\p{{Nl}}\p{{No}}][{W}'’\-]*"

# ---- fixed values: elements that don't start a new container of text ----------------------------------------------------
INLINE_ELEMENTS = (
    "w:t w:delText w:instrText a:t text:s text:tab text:line-break t m:t "
    "w:r w:rPr w:proofErr w:noProof w:lastRenderedPageBreak w:fldSimple w:fldChar w:tab w:br w:cr w:ptab w:softHyphen w:noBreakHyphen w:sym "
    "w:pgNum w:footnoteRef w:endnoteRef w:commentReference w:annotationRef w:separator w:continuationSeparator w:drawing w:object w:ruby w:rt "
    "w:bookmarkStart w:bookmarkEnd w:commentRangeStart w:commentRangeEnd w:permStart w:permEnd w:customXml w:moveFrom w:moveTo "
    "w:hyperlink w:sdt w:sdtContent w:ins w:del w:smartTag w:subDoc a:r a:rPr a:endParaRPr a:br a:tab a:fld "
    "text:span text:a text:bookmark-start text:bookmark-end r rPr m:r m:rPr"
).split()
