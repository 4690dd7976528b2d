"""Declared schemas of the JSON documents; nothing is inferred."""

MANIFEST = ("id string, group_id string, split string, label string, sha256 string, generator string, dataset string, "
            "transformation string, platform string, ground_truth string")
PREDICTION = ("id string, sha256 string, decision string, verdict string, confidence string, elapsed_ms double, "
              "error string, score double")
FRAMES = ("request struct<operations:string>, data struct<frames:array<struct<info:struct<position:string>,"
          "type:struct<ai_generated:string>>>>")
PROBE = ("format struct<duration:string>, streams array<struct<codec_type:string,width:string,height:string,"
         "avg_frame_rate:string>>")
COMMENTS = ("items array<struct<snippet:struct<topLevelComment:struct<snippet:struct<textDisplay:string,"
            "authorChannelId:struct<value:string>>>>>>")
CREDENTIALS = ("active_manifest string, validation_state string, manifests map<string,struct<assertions:array<struct<label:string,"
               "data:struct<actions:array<struct<action:string,digitalSourceType:string>>>>>>>")
