"""Explicit schemas of the documents and tables the engine reads; nothing is inferred."""

from __future__ import annotations

PX = "array<double>"
BOX = "array<array<double>>"
HIT = f"struct<text:string,conf:double,px:{PX},box:{BOX},engine:string,agree:boolean,norm:string,refdes_like:boolean>"
OCR_RUN = (f"run_id string, view string, image string, dpi int, engines array<string>, ts timestamp, "
           f"hits array<{HIT}>, raw_stage1 array<{HIT}>, raw_stage2 array<{HIT}>")
SHAPE = ("struct<idx:int,bbox:array<double>,center:array<double>,wh:array<double>,area:double,aspect:double,"
         "rectangularity:double,radius:double,diameter:double,circularity:double,method:string,category:string,"
         "status:string,refdes:string,crop:string>")
DETECTIONS = (f"_meta struct<view:string,image:string,image_dpi:int>, view string, image string, image_dpi int, "
              f"board_bbox array<double>, rectangles array<{SHAPE}>, circles array<{SHAPE}>")
INDEX_ENTRY = (f"struct<refdes:string,view:string,center:array<double>,box:{BOX},src:string,scale:double,"
               "transform:struct<src_dpi:double,tgt_dpi:double>,tgt_image_dpi:double,tgt_image_size:array<double>,"
               "tgt_board_bbox:array<double>,validated:boolean,agree:boolean,role:string,score:double>")
CHAIN = ("version string, chain array<struct<idx:int,refdes:string,symbol_type:string,sch_px:array<double>,"
         "pcb_px:array<double>,pcb_view:string,walk_d:double,status:string>>, auxiliary array<string>")
LABEL_RECORD = f"struct<refdes:string,x:double,y:double,box:{BOX}>"
LEGEND = ("_meta struct<box:array<double>>, entries array<struct<label:string,px:array<double>,conf:double,"
          "color_bgr:array<int>>>")
ANCHOR = "map<string,struct<label_px:array<double>,note:string>>"
ANCHORS = (f"confirmed_anchors_top {ANCHOR}, confirmed_anchors_bot {ANCHOR}, not_located array<string>, "
           "chain_order_schematic array<string>")
HIT_ROW = ("run_id string, engine string, view_name string, text string, conf double, src_dpi int, x long, y long, "
           "ord long, ts timestamp")
TRUTH_EVENT = "fact long, ts timestamp, seq long, kind string"
PIXEL = "page_id string, x int, y int, b smallint, g smallint, r smallint"
