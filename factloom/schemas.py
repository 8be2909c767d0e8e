"""Schemas of the fact base and of the documents that analyses read and write."""

from __future__ import annotations

from pyspark.sql import types as T

#: Effects that a region may name; 'unknown' propagates but can't be named.
REAL_EFFECTS = ("fs", "net", "db", "clock", "random", "process", "env", "alloc")
UNKNOWN = "unknown"
EDGE_KINDS = ("call", "reference", "type")
RESOLUTIONS = ("call", "reference", "value-flow", "unresolved")


DEFINITIONS = "id string, display string, language string, file string, line_start int, line_end int, is_component boolean"
EDGES = "caller string, callee string, kind string, resolution string, evidence_file string, evidence_line int, seam boolean"
ROOTS = "symbol string, effect string"
SUMMARIES = "symbol string, effect string, evidence_path string"
FACTS_DOC = f"definitions array<struct<{DEFINITIONS}>>, edges array<struct<{EDGES}>>, effect_roots array<struct<{ROOTS}>>"

GRAPH_SYMBOLS = "id string, display string, file string, language string, line_start int, line_end int, loc int, external boolean"
GRAPH_EDGES = "`from` string, `to` string, kind string, resolution string, provenance string, evidence_file string, evidence_line int"

SIGNATURE = (
    "symbol_id string, display string, language string, kind string, file string, line_start int, line_end int, "
    "arity struct<params:int,results:int,generics:int>, "
    "cfg struct<branch_count:int,match_arms:int,loop_count:int,try_count:int,return_points:int,max_nesting:int>, "
    "stmt_histogram map<string,int>, call_sequence array<string>, type_shape struct<params:array<string>,result:string>, "
    "shingles array<bigint>, token_len int, features map<string,string>"
)
IMPLS = (
    "type_name string, file string, line_start int, line_end int, is_enum boolean, variant_count int, "
    "traits array<struct<trait_name:string,trait_full:string,from_arg_shape:string,body_is_match_self:boolean,is_wrapping:boolean,line_start:int,line_end:int>>"
)
OPERAND = "kind:string,local:int,value:struct<ty:string,v:string>"
BODY = (
    "id string, display string, file string, line int, arg_count int, locals array<struct<kind:string>>, "
    f"blocks array<struct<stmts:array<struct<place:int,rvalue:struct<op:string,kind:string,operand:struct<{OPERAND}>,left:struct<{OPERAND}>,right:struct<{OPERAND}>>,loc:struct<file:string,line:int,col:int>>>,"
    f"terminator:struct<kind:string,block:int,target:int,discr:struct<{OPERAND}>,targets:array<struct<value:bigint,block:int>>,otherwise:int,destination:int,successors:array<int>>>>"
)
API_FIELD = "struct<name:string,ty:string,visibility:string,doc:string,optional:boolean>"
API_ITEM = (
    "kind:string,id:string,name:string,visibility:string,modulePath:string,file:string,line:int,doc:string,generics:array<string>,deprecated:boolean,"
    "signature:struct<params:array<struct<name:string,ty:string,optional:boolean,default:string>>,returnType:string,isAsync:boolean,receiver:string,errorType:string,generics:array<string>>,"
    f"fields:array<{API_FIELD}>,variants:array<struct<name:string,fields:array<{API_FIELD}>,discriminant:string,doc:string>>,implements:array<string>,aliasTarget:string,constType:string,constValue:string"
)
API_REPORT = (
    "package struct<name:string,language:string,root:string,version:string>, fidelity struct<source:string,format_version:int,complete:boolean,notes:array<string>>, "
    f"modules array<struct<path:string,file:string,doc:string,items:array<struct<{API_ITEM}>>>>"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
