"""Types of catalog, document, extraction and graph rows."""

from __future__ import annotations

GRAPH = "id long, name string, description string, entity_count int, relation_count int, config string, status byte, graph_name string, graph_status byte, graph_config string, del_flag byte"
TASK = "id long, kg_id long, name string, description string, prompt string, parameters string, message string, entity_count int, relation_count int, retry_count int, status byte, del_flag byte"
FILE = "id long, kg_id long, task_id long, filename string, stored_name string, bucket string, path string"

#: Task states, fixed values.
PENDING, RUNNING, COMPLETED, MERGED, FAILED, CANCELLED = range(6)

NODE = "graph_tag string, node_id string, node_name string, node_type string, description string, props map<string,string>, filename array<string>, graph_level array<string>"
EDGE = "graph_tag string, source_id string, relation_type string, target_id string, weight double, bidirectional boolean, props map<string,string>, filename array<string>, graph_level array<string>"
#: Where a graph applies, fixed values.
LEVELS = ["DocumentLevel", "DomainLevel", "GlobalLevel"]

TOKEN = "struct<idx:int,type:string,start:int,end:int,nl:boolean>"
CHUNK = "chunk_id int, tok_start int, tok_end int, char_start int, char_end int, text string"
EXTRACTION = "struct<extraction_class:string,extraction_text:string,char_interval:struct<start_pos:int,end_pos:int>,alignment_status:string,extraction_index:int,group_index:int,description:string,attributes:map<string,string>>"
ANNOTATED = f"document_id string, text string, extractions array<{EXTRACTION}>"
PROCESSED = "path string, file_type string, success boolean, extracted_text string, metadata map<string,string>, error_message string"

#: The class whose extractions are relations, and the keys of their attributes with fallbacks; fixed values of the extraction format.
RELATION_CLASS = "关系"
SUBJECT_KEYS = ["主体", "主语"]
PREDICATE_KEYS = ["谓词", "谓语"]
OBJECT_KEYS = ["客体", "宾语"]
EXAMPLE_SUBJECT_KEYS = ["subject", "主体", "主语"]
EXAMPLE_PREDICATE_KEYS = ["predicate", "谓词", "关系", "谓语"]
EXAMPLE_OBJECT_KEYS = ["object", "客体", "宾语"]
#: Relation between a merged node and the node that it was matched to.
DERIVED_FROM = "源自于"
#: Relations that allow one object a subject.
SINGLE_VALUED = ["出生于", "成立于", "总部位于", "毕业于"]
