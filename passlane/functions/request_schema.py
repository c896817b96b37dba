"""The intake schema for declaration documents (draft-04 JSON Schema), as data.

Only the keywords compiled by ``passlane.operators.validate`` occur in it.
"""

from __future__ import annotations

import json

# ---------------------------------------------------------------------------
# The schema documents are validated against. It must equal the
# service's schema key for key, so it is kept verbatim as JSON text.
# ---------------------------------------------------------------------------

REQUEST_SCHEMA_JSON = r"""
{
  "$schema": "http://json-schema.org/draft-04/schema#",
  "description": "PAS02 - Passenger Declaration Request",
  "type": "object",
  "minProperties": 1,
  "maxProperties": 2,
  "properties": {
    "simpleDeclarationRequest": {
      "type": "object",
      "properties": {
        "requestCommon": {
          "$ref": "#/definitions/requestCommon"
        },
        "requestDetail": {
          "type": "object",
          "minProperties": 1,
          "properties": {
            "customerReference": {
              "$ref": "#/definitions/customerReference"
            },
            "personalDetails": {
              "$ref": "#/definitions/personalDetails"
            },
            "contactDetails": {
              "$ref": "#/definitions/contactDetails"
            },
            "declarationHeader": {
              "$ref": "#/definitions/declarationHeader"
            },
            "declarationTobacco": {
              "$ref": "#/definitions/declarationTobacco"
            },
            "declarationAlcohol": {
              "$ref": "#/definitions/declarationAlcohol"
            },
            "declarationOther": {
              "$ref": "#/definitions/declarationOther"
            },
            "liabilityDetails": {
              "type": "object",
              "minProperties": 1,
              "properties": {
                "totalExciseGBP": {
                  "$ref": "#/definitions/DecimalString13.2"
                },
                "totalCustomsGBP": {
                  "$ref": "#/definitions/DecimalString13.2"
                },
                "totalVATGBP": {
                  "$ref": "#/definitions/DecimalString13.2"
                },
                "grandTotalGBP": {
                  "$ref": "#/definitions/DecimalString13.2"
                }
              },
              "required": [
                "grandTotalGBP"
              ],
              "additionalProperties": false
            },
            "amendmentLiabilityDetails": {
              "additionalProperties": false,
              "properties": {
                "additionalExciseGBP": {
                  "$ref": "#/definitions/DecimalString13.2"
                },
                "additionalCustomsGBP": {
                  "$ref": "#/definitions/DecimalString13.2"
                },
                "additionalVATGBP": {
                  "$ref": "#/definitions/DecimalString13.2"
                },
                "additionalTotalGBP": {
                  "$ref": "#/definitions/DecimalString13.2"
                }
              },
              "type": "object"
            }
          },
          "required": [
            "customerReference",
            "contactDetails",
            "declarationHeader",
            "liabilityDetails"
          ],
          "additionalProperties": false
        }
      },
      "required": [
        "requestCommon",
        "requestDetail"
      ],
      "additionalProperties": false
    }
  },
  "required": [
    "simpleDeclarationRequest"
  ],
  "additionalProperties": true,
  "definitions": {
    "requestCommon": {
      "type": "object",
      "properties": {
        "receiptDate": {
          "$ref": "#/definitions/receiptDate"
        },
        "acknowledgementReference": {
          "$ref": "#/definitions/acknowledgementReference"
        },
        "requestParameters": {
          "type": "array",
          "items": {
            "type": "object",
            "properties": {
              "paramName": {
                "type": "string",
                "minLength": 1,
                "maxLength": 100
              },
              "paramValue": {
                "type": "string",
                "minLength": 1,
                "maxLength": 255
              }
            },
            "required": [
              "paramName",
              "paramValue"
            ],
            "additionalProperties": false
          }
        }
      },
      "required": [
        "receiptDate",
        "acknowledgementReference",
        "requestParameters"
      ],
      "additionalProperties": false
    },
    "contactDetails": {
      "type": "object",
      "properties": {
        "emailAddress": {
          "type": "string",
          "maxLength": 132
        }
      },
      "additionalProperties": false
    },
    "customerReference": {
      "type": "object",
      "properties": {
        "idType": {
          "$ref": "#/definitions/String40"
        },
        "idValue": {
          "$ref": "#/definitions/String40"
        },
        "ukResident": {
          "type": "boolean"
        }
      },
      "required": [
        "idType",
        "idValue",
        "ukResident"
      ],
      "additionalProperties": false
    },
    "personalDetails": {
      "type": "object",
      "properties": {
        "firstName": {
          "$ref": "#/definitions/String35"
        },
        "lastName": {
          "$ref": "#/definitions/String35"
        }
      },
      "required": [
        "firstName",
        "lastName"
      ],
      "additionalProperties": false
    },
    "declarationHeader": {
      "type": "object",
      "properties": {
        "messageTypes": {
          "$ref": "#/definitions/messageTypesObject"
        },
        "chargeReference": {
          "$ref": "#/definitions/String14"
        },
        "portOfEntry": {
          "$ref": "#/definitions/String40"
        },
        "expectedDateOfArrival": {
          "$ref": "#/definitions/DateType"
        },
        "timeOfEntry": {
          "$ref": "#/definitions/TimeType"
        },
        "travellingFrom": {
          "$ref": "#/definitions/String60"
        },
        "uccRelief": {
          "type": "boolean"
        },
        "ukVATPaid": {
          "type": "boolean"
        },
        "ukExcisePaid": {
          "type": "boolean"
        },
        "onwardTravelGBNI": {
          "enum": [
            "GB",
            "NI"
          ],
          "maxLength": 2,
          "minLength": 2,
          "type": "string"
        },
        "portOfEntryName": {
          "$ref": "#/definitions/String40"
        }
      },
      "required": [
        "chargeReference",
        "travellingFrom",
        "onwardTravelGBNI",
        "uccRelief",
        "ukVATPaid",
        "ukExcisePaid",
        "messageTypes"
      ],
      "additionalProperties": false
    },
    "declarationTobacco": {
      "type": "object",
      "properties": {
        "totalExciseTobacco": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "totalCustomsTobacco": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "totalVATTobacco": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "declarationItemTobacco": {
          "type": "array",
          "items": {
            "$ref": "#/definitions/declarationItemTobaccoObject"
          }
        }
      },
      "additionalProperties": false
    },
    "declarationAlcohol": {
      "type": "object",
      "properties": {
        "totalExciseAlcohol": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "totalCustomsAlcohol": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "totalVATAlcohol": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "declarationItemAlcohol": {
          "type": "array",
          "items": {
            "$ref": "#/definitions/declarationItemAlcoholObject"
          }
        }
      },
      "additionalProperties": false
    },
    "declarationOther": {
      "type": "object",
      "properties": {
        "totalExciseOther": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "totalCustomsOther": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "totalVATOther": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "declarationItemOther": {
          "type": "array",
          "items": {
            "$ref": "#/definitions/declarationItemOtherObject"
          }
        }
      },
      "additionalProperties": false
    },
    "receiptDate": {
      "type": "string",
      "pattern": "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z",
      "format": "date-time"
    },
    "declarationItemAlcoholObject": {
      "type": "object",
      "properties": {
        "commodityDescription": {
          "$ref": "#/definitions/String40"
        },
        "volume": {
          "$ref": "#/definitions/StringInteger17"
        },
        "goodsValue": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "valueCurrency": {
          "$ref": "#/definitions/String3"
        },
        "originCountry": {
          "$ref": "#/definitions/String3"
        },
        "exchangeRate": {
          "$ref": "#/definitions/DecimalString13.5"
        },
        "exchangeRateDate": {
          "$ref": "#/definitions/DateType"
        },
        "goodsValueGBP": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "VATRESClaimed": {
          "type": "boolean"
        },
        "exciseGBP": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "customsGBP": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "vatGBP": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "valueCurrencyName": {
          "$ref": "#/definitions/String40"
        },
        "originCountryName": {
          "$ref": "#/definitions/String60"
        },
        "ukVATPaid": {
          "type": "boolean"
        },
        "ukExcisePaid": {
          "type": "boolean"
        },
        "madeIn": {
          "$ref": "#/definitions/String40"
        },
        "euCustomsRelief": {
          "type": "boolean"
        }
      },
      "additionalProperties": false
    },
    "declarationItemOtherObject": {
      "type": "object",
      "properties": {
        "commodityDescription": {
          "$ref": "#/definitions/String40"
        },
        "quantity": {
          "$ref": "#/definitions/StringInteger17"
        },
        "goodsValue": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "valueCurrency": {
          "$ref": "#/definitions/String3"
        },
        "originCountry": {
          "$ref": "#/definitions/String3"
        },
        "exchangeRate": {
          "$ref": "#/definitions/DecimalString13.5"
        },
        "exchangeRateDate": {
          "$ref": "#/definitions/DateType"
        },
        "goodsValueGBP": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "VATRESClaimed": {
          "type": "boolean"
        },
        "exciseGBP": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "customsGBP": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "vatGBP": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "valueCurrencyName": {
          "$ref": "#/definitions/String40"
        },
        "originCountryName": {
          "$ref": "#/definitions/String60"
        },
        "ukVATPaid": {
          "type": "boolean"
        },
        "uccRelief": {
          "type": "boolean"
        },
        "madeIn": {
          "$ref": "#/definitions/String40"
        },
        "euCustomsRelief": {
          "type": "boolean"
        }
      },
      "additionalProperties": false
    },
    "messageTypesObject": {
      "additionalProperties": false,
      "properties": {
        "messageType": {
          "maxLength": 30,
          "minLength": 1,
          "type": "string",
          "enum": [
            "DeclarationCreate",
            "DeclarationAmend"
          ]
        }
      },
      "required": [
        "messageType"
      ],
      "type": "object"
    },
    "declarationItemTobaccoObject": {
      "type": "object",
      "properties": {
        "commodityDescription": {
          "$ref": "#/definitions/String40"
        },
        "quantity": {
          "$ref": "#/definitions/StringInteger17"
        },
        "weight": {
          "$ref": "#/definitions/StringInteger17"
        },
        "goodsValue": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "valueCurrency": {
          "$ref": "#/definitions/String3"
        },
        "originCountry": {
          "$ref": "#/definitions/String3"
        },
        "exchangeRate": {
          "$ref": "#/definitions/DecimalString13.5"
        },
        "exchangeRateDate": {
          "$ref": "#/definitions/DateType"
        },
        "goodsValueGBP": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "VATRESClaimed": {
          "type": "boolean"
        },
        "exciseGBP": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "customsGBP": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "vatGBP": {
          "$ref": "#/definitions/DecimalString13.2"
        },
        "valueCurrencyName": {
          "$ref": "#/definitions/String40"
        },
        "originCountryName": {
          "$ref": "#/definitions/String60"
        },
        "ukVATPaid": {
          "type": "boolean"
        },
        "ukExcisePaid": {
          "type": "boolean"
        },
        "madeIn": {
          "$ref": "#/definitions/String40"
        },
        "euCustomsRelief": {
          "type": "boolean"
        }
      },
      "additionalProperties": false
    },
    "acknowledgementReference": {
      "type": "string",
      "minLength": 1,
      "maxLength": 32
    },
    "String3": {
      "type": "string",
      "minLength": 1,
      "maxLength": 3
    },
    "String35": {
      "type": "string",
      "minLength": 1,
      "maxLength": 35
    },
    "String40": {
      "type": "string",
      "minLength": 1,
      "maxLength": 40
    },
    "String60": {
      "type": "string",
      "minLength": 1,
      "maxLength": 60
    },
    "String14": {
      "type": "string",
      "minLength": 14,
      "maxLength": 14
    },
    "StringInteger17": {
      "type": "string",
      "minLength": 1,
      "maxLength": 17
    },
    "DecimalString13.2": {
      "type": "string",
      "maxLength": 14,
      "pattern": "^-?[0-9]{1,11}[.][0-9]{1,2}$"
    },
    "DecimalString13.5": {
      "type": "string",
      "maxLength": 13,
      "pattern": "^-?[0-9]{1,7}[.][0-9]{1,5}$"
    },
    "DateType": {
      "type": "string",
      "minLength": 10,
      "maxLength": 10,
      "pattern": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
    },
    "DateTimeType": {
      "type": "string",
      "pattern": "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
    },
    "TimeType": {
      "type": "string",
      "minLength": 5,
      "maxLength": 5,
      "pattern": "[0-9]{2}:[0-9]{2}"
    }
  }
}
"""

REQUEST_SCHEMA: dict = json.loads(REQUEST_SCHEMA_JSON)
