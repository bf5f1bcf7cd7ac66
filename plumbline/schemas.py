"""Explicit schemas of everything read from files; nothing is inferred."""

from __future__ import annotations

FRAMES = (
    "run_id string, frame int, width int, height int, depth array<float>, "
    "confidence array<float>, intrinsics array<double>, extrinsics array<double>"
)

ARTIFACT = "struct<kind:string,name:string,size_bytes:bigint,sha256:string,url:string,gs_uri:string>"

MANIFEST = (
    "schema_version string, run_id string, model_repository_id string, model_revision string, "
    "depth_mode string, linear_unit string, "
    "params struct<fps:double,source_duration_s:double,process_res:int,process_res_method:string,"
    "ref_view_strategy:string,infer_gs:boolean,max_frames:int>, "
    "frames struct<count:int,requested_count:int,width:int,height:int,capped:boolean,effective_fps:double>, "
    "timing struct<gpu_seconds:double,wall_seconds:double,model_load_seconds:double>, "
    "vram struct<peak_bytes:bigint,current_bytes:bigint,total_bytes:bigint,device_name:string,"
    "torch_peak_bytes:bigint,baseline_bytes:bigint>, "
    f"artifacts array<{ARTIFACT}>, "
    "diagnostics struct<native_npz:map<string,array<string>>,export_dir_listing:array<string>,"
    "publish_mode:string,publish_errors:array<string>>, "
    "transient boolean, expires_after_days int, mock boolean"
)

RULER = "struct<bottom:array<double>,top:array<double>>"

OBSERVATION = (
    "struct<id:string,objectId:string,runId:string,trialIndex:int,canonicalFrame:int,npzFrame:int,"
    "rawM:double,internalSpreadM:double,pointCount:bigint,capturedAt:string,sittingId:string,"
    "paintDurationMs:bigint,floorSupportFraction:double,confidenceThreshold:double,"
    "mask:struct<width:int,height:int,revision:int,paintedPixels:bigint,digest:string,"
    "runs:array<int>,source:string>,"
    f"ruler:{RULER},rulerKind:string>"
)

PACKET = (
    "schemaVersion string, evidenceId string, runId string, "
    "target struct<id:string,code:string,name:string,definition:string,truthM:double,mode:string,"
    "suggestedFrame:int>, "
    f"observation {OBSERVATION}, "
    "live struct<cloudSource:string,"
    f"measurement:struct<mode:string,rawM:double,internalSpreadM:double,pointCount:bigint,ruler:{RULER},rulerKind:string>,"
    "ground:struct<plane:struct<normal:array<double>,offset:double>,supportFraction:double,rmseM:double,"
    "tiltDeg:double,belowFraction:double,gravityCoherence:double>>, "
    "storedAt string"
)

SWEEPS = (
    "sweeps array<struct<label:string,date:string,contaminated:boolean,method:string,"
    "runs:array<struct<frames:int,process_res:int,peak_bytes:bigint,torch_peak_bytes:bigint,"
    "baseline_bytes:bigint,gpu_seconds:double,wall_seconds:double,ok:boolean>>>>"
)
