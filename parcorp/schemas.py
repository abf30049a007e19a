"""Schemas of the files the engine reads."""

TEXTS = "id string, transliteration string, period string, genre string"
ARTIFACTS = "artifact_id bigint, artifact_type string"
ASSETS = "artifact_id bigint, asset_type string, path string, file_format string"
ATF_RECORDS = (
    "id string, genres array<struct<genre: struct<genre: string>>>, "
    "period struct<period: string>, inscription struct<atf: string>"
)
GENERATED = "id string, transliteration string, translation string, genre string, period string"
INDEX = "index map<string, string>"

_AKA = "`j:aka`: array<struct<`sl:aka`: struct<n: string>>>"
_VALUES = "`j:values`: array<struct<`sl:v`: struct<n: string>>>"
_FORM = f"struct<n: string, `sl:ucun`: string, {_AKA}, {_VALUES}>"
_SIGN = (
    f"struct<n: string, `sl:ucun`: string, {_AKA}, {_VALUES}, "
    f"`j:forms`: array<struct<`sl:form`: {_FORM}>>>"
)
SIGN_LIST = (
    "`sl:signlist` struct<`j:letters`: array<struct<`sl:letter`: "
    f"struct<`j:signs`: array<struct<`sl:sign`: {_SIGN}>>>>>>"
)
