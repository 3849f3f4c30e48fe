"""Digests of the canonical form of whole licence texts too long to be listed.

Texts: those of Debian's /usr/share/common-licenses, with and without what follows the terms ("How to
apply ..."), as they are, rewrapped paragraph by paragraph at 50 to 120 columns and unwrapped.  A text
has several digests where a notice in it ends with its line.
"""

DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-2.0", "057afbf84d7e3a6244096c9bc0afe67486efd16aaaaadcc26d0b6fd372f1f847"),
    ("GPL-2.0", "12befb470f4c80abde09a678256bd972b8124844f9ade6f210bef15e5830029c"),
    ("GPL-2.0", "2452f6fa07e3cd9ff30269e5023ee6d274e37491952c0b52827c853cae7ea915"),
    ("GPL-2.0", "2fd9d8d30efe4a0b1c7d8f6bbb7ac0b8be2cc580b74938332241d794a860dbc9"),
    ("GPL-2.0", "30d1930f9e49d15e93f93abbbc3498a4f10d65c92188ef43add9f1f95f03f923"),
    ("GPL-2.0", "328e085146cbe19f92fc2e998481cd2304f533bb468fd406575ec940704b85c6"),
    ("GPL-2.0", "4133a5b4d11029acdaa3f2c352e52a317530e24f19239f7e6bdb0a7f3531d637"),
    ("GPL-2.0", "433a1ef2fd09b6e434c4c850b3244c10ffcfef28dba4da112b784ac44c199a66"),
    ("GPL-2.0", "4f2e40202b2f45c9a11e59b416db9d0a8c2e8b4d04f326bbcf37adc0eaa5a4a8"),
    ("GPL-2.0", "6dbe0f3282979df3ff1020b439f396cb0e16ccc74eb67738361705b310722cfd"),
    ("GPL-2.0", "6e32380d1f0d84485692625ba94bb8850b44b61c6979c72dc454c6862f2a8d88"),
    ("GPL-2.0", "76de7dc4b03327a4705f95b512b0de33cec1305f3004e60aac597d8e1e225309"),
    ("GPL-2.0", "78a6ed308dcb211e89315d07b2ad3a7a0f011cb22343abca8046041179d996f9"),
    ("GPL-2.0", "7d2ae223250c3a79dae12127b2795270a451718578040ef95ed3668829f7c0dd"),
    ("GPL-2.0", "8ab28b1b8d02b003b5bbaa3bae57b0df52af56bf22b03b314240d1f03299442b"),
    ("GPL-2.0", "8cd933a04167c57ae0bf1a02ca238ff368fb3130239e13cdf4da0b093b7107a9"),
    ("GPL-2.0", "904aa4bd2ca45a370057f56ef72f69688ea8bf4c90996c9c2d92fd721f5db394"),
    ("GPL-2.0", "90b41a811d42d3d9171a54ad4bc678f0d817ace7537d754232861225a8fb2a26"),
    ("GPL-2.0", "977b2a39d353c1010b63cd012b32c7e20699399dbcf98af44a8a6bad01309c00"),
    ("GPL-2.0", "a2e423d669ce808a5adf46a3d7b692694d3457e811807900864f92d9aa120e79"),
    ("GPL-2.0", "afe81f2427401c30a278cc79f3127910306fa7fbab983f81a88e13aad832ee5f"),
    ("GPL-2.0", "b5978e68cc9f78f32624a899aec08dafa535316e22b217a38dc72529465cc984"),
    ("GPL-2.0", "b65fc6335afc20223f4eb2f226082432562f899684b7a0da12e29ff4f102a962"),
    ("GPL-2.0", "be89ca04802a7fc16b6a1d36d0514549ec5638073a0f8caed332d87b85683f18"),
    ("GPL-2.0", "c19962d091128681be40c4e177b79ad823827b6d6e940707e900ba04ef8e28a3"),
    ("GPL-2.0", "d3bad25df73790cccd1261616b522e89c1a0f078a8bf79f7b31edc36a73ee94b"),
    ("GPL-2.0", "e21ff31544abec0b8e72724448d45fd304a6fec57e41868cc349f5a6aa90848f"),
    ("GPL-2.0", "e5c988b1667f1f70c1446f37279896a0225211500f48934098c84e1572fda43e"),
    ("GPL-2.0", "e9f16e28520eed7c8564e06b84ba3e170a28285a2cefa010aaddcc84f187d863"),
    ("GPL-2.0", "eaa07abbdf099a88e8e256a344f50eaf34c4e1eb757e3b2a166a3c0db1c1cdd9"),
    ("GPL-2.0", "ed2a896f48d0d6cd6f89ddfaab5809f06d64b6663a4ba44a698b04c8019cd078"),
    ("GPL-2.0", "f20a8767410fc7e55ec3258ca9da60b2dd9fc84a4c8f9f02c61b3550d6974772"),
    ("GPL-2.0", "f28b0ebdc624dc7390e021a91ee7067d52d2b710915f5439a93f6ac302052f61"),
    ("GPL-2.0", "f67656023e9f951fc47ecce53b899ac05b9cc19b9f1d5f7004e8d9172bf2b398"),
    ("GPL-2.0", "f79b9e516923cc213c21d12fd8a51b4067992b2728a442e31fd53d078dd25632"),
    ("GPL-2.0", "f837bb755a60acbf5a27470f932d7094465cb299045df71ab225f0e187d16b80"),
    ("GPL-2.0", "fafe0a7cec9f53c455c05dec82bebdb15ac892fc59723962818dc8ab6b6ac483"),
    ("GPL-2.0", "fb1b033e531d18f0a15f5ad7585d358932f051a84e61cc2d5cb2aa9ed676caf0"),
    ("GPL-3.0", "011c8c889c89be2a72df69e906a2d59658701de43de1027ebb9d1a21efa01d77"),
    ("GPL-3.0", "28a9147bc54bb9c1d7836b26d80da60cb41f94aa187e889072be3ed70f84b041"),
    ("GPL-3.0", "2c53a1d3b473bf0aca6754556035bf01c16a7823cd501625ba1de299f462e560"),
    ("GPL-3.0", "2f5326aa8a00f9aaec5990337239231da07ca0fa219229d7bd0c79afd3cfbe60"),
    ("GPL-3.0", "36aae06826885e8e969839cdee104d62644ee2f7fe77feb43c9758a6a665f0cb"),
    ("GPL-3.0", "4b750d632cf4ac5860fc0a0e0e8ec9d8d182f2037eb695c788e8d673d81a6c4f"),
    ("GPL-3.0", "5ad3e0838e8b108ce67632aa541bf4bc6962f2caf14beebc26102cd1084ddb00"),
    ("GPL-3.0", "6c4f9ede2b8454cbf4b1f9f2327ffb3944f450a3ba8fd387bb6d65a8f5158755"),
    ("GPL-3.0", "6f0ecec1a740533bb52cf5c646b94fc9d4c1b18d1589abdb810288561df586a5"),
    ("GPL-3.0", "802e70f1cda4518096527fd00e7281b5d15b97943a9dc87273116607d21af9b2"),
    ("GPL-3.0", "9be44ab82b4b989d115dbe9483418d8b9f25353105635c43d76248368b354b9b"),
    ("GPL-3.0", "d1bdf910bd65e90bec2f67e6f5ae002073f099497c21c57cab132bc5d867295d"),
    ("GPL-3.0", "f3424cb42c91fa81c5543118e91a09ca1afddde4f17ca4fe5749904445104a52"),
    ("GPL-3.0", "f6ed60e5519a67693b187483488ff52e0b601c646f62721c1c01d3b401ff8690"),
    ("LGPL-2.1", "00927d996732f92e916d980733f9ea07ef1cc780829ca5b4fd1dc03f65200b94"),
    ("LGPL-2.1", "07a1826dff8eae703af98e8c38f496ee16e8335bf010c2c3378936011fb62a93"),
    ("LGPL-2.1", "0bc2f900365fa74948ceece76db22eab85fa23420606bc5c5137f22f89cde2c5"),
    ("LGPL-2.1", "0c21f3614d408bb9a8e938f4c975b78bc24b641aaddcd34b3d3fdbc1da804cfd"),
    ("LGPL-2.1", "1b028405aca9097b9b26f7a54267c3b47815011da060a55e90e42ae7eb3b8a26"),
    ("LGPL-2.1", "26f00fb7b63e22b1932187c6cb740eb6a3289f4fd4502b3b731b29832d76cbe0"),
    ("LGPL-2.1", "30258019a72be9d7230fbb3bf4cb98fb112cedd4caffdf17f4c156163ff262b8"),
    ("LGPL-2.1", "375ce461f0b787eeda0905b1ad7a1786a036013f293b25fa84eaa110cf42228c"),
    ("LGPL-2.1", "51d50a2196491ba81648d8d09aa62ccd2d644f63f7d0f0ce90d473c641fb2010"),
    ("LGPL-2.1", "563b3a90d7045d3bbdd01d015b4b78dcb37d618e59dc4a974b99cd0532ede9ff"),
    ("LGPL-2.1", "58adb960767959bd9e56f59fad886444628b436b9f0796e8fe2d9ec2bf654bd0"),
    ("LGPL-2.1", "5ce6fa0934cb8db1e96d36322f81fd98d11cc658ec86c71b9519d9c723a13041"),
    ("LGPL-2.1", "632c4b75356f6bc2a2deb1211d6c0958db04ce71222502f674de0666579bb8a2"),
    ("LGPL-2.1", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    ("LGPL-2.1", "77fed92451ecee62d4a907f6332aa32c3909e7e2f83a2554e709a4c88fa2da17"),
    ("LGPL-2.1", "7c40246883820cf81e406a516a734f0b4bbad10c34f052ba8da3abe8bb7701d4"),
    ("LGPL-2.1", "82818e0a11a2a5a31d4638e460c16cad8e3d620a3d0dd13ca9029910f53ab4d1"),
    ("LGPL-2.1", "872111af492d537504ee920ac70af4d394e30aba93c343e87d87dd460f0fd722"),
    ("LGPL-2.1", "8cb068ae92e0bc665cccaa796964df6819cde850b4434a85bd0c1c7859e4a85c"),
    ("LGPL-2.1", "a5a9feb2460c8021828cd3838496137e22c9ed91e41639b2e2416441d5c71481"),
    ("LGPL-2.1", "ac75fc7405bf8e1ed2b64b791fe9c74ac84424867c9f58950b4c11ecb34799fd"),
    ("LGPL-2.1", "ad83fb939127b50d3ff5605cbd49cb5face4119deadacc26c3a71007078330a0"),
    ("LGPL-2.1", "ae9bae4f59c27578b14201a40fb4f970d6a5ae07b2f8d5555ebf640a96c64731"),
    ("LGPL-2.1", "b117585182d76b3414ca5f67fa92f37c2df835e2113c002ce460aa6b99cc8737"),
    ("LGPL-2.1", "c7c9fe99f5cf5f995e0cac56892fa05f50d688060240a31f39ddf33dbe708744"),
    ("LGPL-2.1", "cb566eeda4887d5ab91cf1b007341948c42edf002469afd3440cab44a25da357"),
    ("LGPL-2.1", "cdf8853b9da6fbe4aa97d51bc43803c378e07da503afb3d39971d64a32b7e79c"),
    ("LGPL-2.1", "dafd6b2636e6bbcdbf6c86f14e4e963fb9c46d770ea4361f95459c4f79ec83e2"),
    ("LGPL-2.1", "df45455d51fa2f984513a3934e18bbd0d6761306c4edb32136e03ae0ff74f04e"),
    ("LGPL-2.1", "e40ac91085d7654a33b372b772494d9cbb394c9a2a895909b1597bb1c0032567"),
    ("LGPL-2.1", "ee541700607c9ebd8432cde1195e0c49ac093a0e671139b0df0e846be8ff7e9c"),
    ("LGPL-2.1", "f4cff9f01ca3dc16d8a712df3d4e1cdc414df32b939c69676e9f436b71a38b8f"),
    ("LGPL-2.1", "f85c7da15139178b6a9082f6e48df0960dc65168a36bab4529e9d5cebf276279"),
    ("LGPL-3.0", "14d429c34d7d0b7224c56c9c557f930aae2b4ff2ed2771b973183c55827840f4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)
