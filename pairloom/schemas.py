"""Explicit schemas of the stored documents; nothing is inferred from JSON."""

ANSWER = "struct<type:string,choice:string,confidence:double,probabilities:map<string,double>>"
JOURNAL = (
    "seq bigint, type string, mode string, unitId string, requestHash string, status string, servedModel string, latencyMs double, "
    "recordedAt string, reason string, previousHash string, eventHash string, usage struct<input_tokens:bigint,output_tokens:bigint>, "
    f"answers map<string,{ANSWER}>, failure struct<kind:string,httpStatus:int,validation:string>"
)
SIGNAL = "id string, version string, status string, kinds array<string>, question string, presence string, criteria map<string,string>, unitFilter string, evidence array<string>"
CASE = "id string, signalId string, files map<string,string>, label struct<value:string,source:struct<type:string,who:string,date:string,note:string>>, focus array<string>, tags array<string>"
LABEL_FILE = (
    "schema string, labelerKind string, labeler string, reviewer string, sourceType string, who string, "
    "cards array<struct<cardId:string,evaluations:array<struct<signalId:string,label:string,rationale:string>>>>, "
    "labels array<struct<cardId:string,signalId:string,label:string,note:string>>"
)
CONFIG = "path string, extends string, options map<string,string>"
EXTERNAL_CONFIG = "specifier string, package string, version string, integrity string, entry string, files map<string,string>"
